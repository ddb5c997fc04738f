import pytest

from vecloom.llm import pii


@pytest.fixture(scope="module")
def found():
    model = pii.trained()
    return lambda text: [(k, text[a:b]) for k, a, b in pii.field_spans(text, pii.base_spans(text), model)]


@pytest.mark.parametrize("named", [0, 25, 49])
def test_one_naming_decides_all_occurrences(found, named):
    secret = "Zk3jH8xQp2mN5vT"
    parts = [f"and so on then {secret} again."] * 50
    parts[named] = f"use token = {secret} here"
    assert found(" ".join(parts)) == [("secret", secret)] * 50
    assert not found(" ".join(["and so on then", secret, "again."] * 50))


@pytest.mark.parametrize(
    "kind, number, text",
    [("id", "DE89 3704 0044 0532 0130 00", "send it to iban {} today"), ("id", "DE89 3704 0044 0532 0130 00", "send it to {} today"), ("phone", "030 1234 5678", "call tel: {} now")],
)
def test_groups_of_one_number_decide_together(found, kind, number, text):
    assert found(text.format(number)) == [(kind, x) for x in number.split()]


def test_chains_leave_plain_numbers(found):
    assert not found("in 1998 2001 2004 and 12 30 45 on 2024-01-02 10:30 12 units")


HEX = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


@pytest.mark.parametrize("text", ["api_key={}", "password:{}", '{{"token":"{}"}}', '{{"a":1,"token":"{}","user":"x@y.com"}}', "a@b.com:{}", "https://x.com/a?user=1&token={}"])
def test_secrets_attached_to_something(found, text):
    for secret in (HEX, "Zk3jH8xQp2mN5vT") if "b.com" not in text else (HEX,):
        assert found(text.format(secret)) == [("secret", secret)]


def test_what_stays_whole(found):
    assert not found("at 10:30, see 1,234.50 (12) or x=12 y=13, f(a1,b2) at https://x.com/page?id=12")
    assert not found("x=12 and id=12 and key=12 " * 20)


def exact_marginals(unary, edges, agree, chain, move):
    """Beliefs by trying every labelling."""
    from itertools import product

    import numpy as np

    n, k = unary.shape
    out = np.zeros((n, k))
    for labels in product(range(k), repeat=n):
        score = sum(unary[i, x] for i, x in enumerate(labels))
        score += sum(w for (a, b), w in zip(edges, agree) if labels[a] == labels[b])
        score += sum(move[labels[i], labels[i + 1]] for i in chain)
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(8))
def test_messages_give_the_marginals(seed):
    """Exactly on trees; near them, with the same best labels, where chain and links form loops."""
    import numpy as np

    rng = np.random.default_rng(seed)
    unary, move = rng.normal(size=(6, 3)) * 1.5, rng.normal(size=(3, 3))
    cases = [([(0, 3), (2, 5)], [0, 1], True), ([(0, 5)], [2], True), ([(0, 2), (3, 5)], [0, 1, 2, 3, 4], False), ([(0, 3)], [0, 1, 2], False)]
    for edges, chain, is_tree in cases:
        agree = rng.uniform(0.2, 2.0, size=len(edges))
        want = exact_marginals(unary, edges, agree, chain, move)
        belief = pii.marginals(unary, edges, agree, chain, move)
        got = np.exp(belief - belief.max(axis=1, keepdims=True))
        got /= got.sum(axis=1, keepdims=True)
        assert np.abs(got - want).max() < (2e-3 if is_tree else 0.15)


def test_agreement_is_learnt_from_both_sides():
    _, agree, move = pii.trained()
    assert 0.5 < agree < 5  # most similar tokens of the examples agree, some don't
    assert move.shape == (len(pii.LABELS),) * 2 and move[pii.LABELS.index("id"), pii.LABELS.index("id")] > move[pii.LABELS.index("id"), 0]


def test_words_before_a_token_are_whole(found):
    far = "x" * 300
    assert pii._before(f"one two {far} ", 309) == ["two", far]
    assert pii._before("  " * 200, 400) == [] and pii._before("a b", 3) == ["a", "b"] and pii._before("", 0) == []
    assert found(f"the secret {far} {HEX} then") == [("secret", HEX)]


def test_recall_by_kind(found):
    """Spans beyond the base, planted by rule in plain words."""
    import random

    rng = random.Random(77)
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = {
        "secret": lambda: (f"{rng.choice(['token', 'api_key', 'password', 'secret'])}{rng.choice(['=', ': ', ' = '])}", "".join(rng.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(rng.randint(16, 36))) + "a1"),
        "id": lambda: (rng.choice(["ssn ", ""]), f"{num(3)}-{num(2)}-{num(4)}"),
        "phone": lambda: (rng.choice(["tel: ", "phone ", "call "]), f"{num(3)}-{num(3)}-{num(4)}"),
    }
    hit = dict.fromkeys(forms, 0)
    for kind, form in forms.items():
        for _ in range(100):
            lead, value = form()
            text = " ".join([*(word() for _ in range(12)), lead + value, *(word() for _ in range(12))])
            hit[kind] += (kind, value) in found(text)
    assert all(n >= 90 for n in hit.values()), hit
    plain = [" ".join(rng.choice([word(), num(rng.randint(1, 5)), f"{num(2)}.{num(1)}"]) for _ in range(40)) for _ in range(100)]
    assert sum(bool(found(t)) for t in plain) <= 2
