"""Personal data: patterns, and a skip-chain conditional random field for the rest.

Four kinds are found by fixed patterns (the base). Every token with a digit or an at
sign then is a node of a conditional random field. Its own potentials are log-linear
in the token's shape and the words before it; nodes with no word between are chained
by trained transitions, so that the groups of one number decide together, and
distant nodes with the same or a similar text (the same digits, the same mail domain)
are linked too, through one hub for each text, so that a token that is plain in one
place decides all others. Loopy message passing gives each node's label. Weights are trained here, by likelihood
on seeded examples made by rule, once for each call of ``detected``.

Offsets are code points. Patterns run in linear time over texts of any length.

Defined results: a null or empty text has no spans; repeated rows are searched each
on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone", "secret", "id")
LABELS = ("", *KINDS)

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_TOKEN = re.compile(r"(?<!\S)\S*?[0-9@]\S*")
_CUTS = re.compile(r"[=:\"'`()\[\]{}<>,“”«»]+")
_PAGE = re.compile(r"https?://[^\s?\"'<>{}]*")
_PAGE_CUTS = re.compile(r"[=:\"'`()\[\]{}<>,“”«»?&#;]+")
_WHOLE = re.compile(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[$€£]?[0-9]+([.,][0-9]+)*[%€$]?|[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2})+")
_LETTER = re.compile(r"\w")
_EDGE = "\"'`()[]{}<>.,;:!?|#$%&*=~^“”«»"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches from one at sign to the next: the local part reaches back as far as its
    characters go, but not into the match before."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            # a run that fails here is not looked through again from its start
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


_TRIGGERS = {
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "bearer", "credential"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono"},
    "ip": {"ip", "host", "address", "server"},
    "id": {"ssn", "passport", "iban", "account", "konto", "dni", "nif", "licence"},
}
_SHAPES = [
    re.compile(x)
    for x in (
        r"[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"@\w+",
        r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
        r"[0-9]{1,3}",
        r"[0-9]{4}",
        r"[0-9]{5,8}",
        r"[0-9]{9,12}",
        r"[0-9]{13,19}",
        r"[0-9]{20,}",
        r"[0-9]+(\.[0-9]+){1,2}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}",
        r"[A-Z]{2}[0-9]{2}",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        r"[0-9a-fA-F]{32,}",
        r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_\-./+]{20,}",
        r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9_\-]{12,19}",
        r"(?=.*[A-Za-z])[A-Za-z0-9-]{1,11}",
        r"\+?[0-9(][0-9()\-]{2,}",
        r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?",
        r"https?://.*",
        r"[$€£]?[0-9]+([.,][0-9]+)*[%€$]?",
    )
]
#: Features of the token itself; the others are of the words before it.
OF_TOKEN = 1 + len(_SHAPES) + 2


def features(token: str, before: str, before2: str) -> np.ndarray:
    d = _digits(token)
    near = {before.strip(_EDGE).lower(), before2.strip(_EDGE).lower()}
    values = [1, *(bool(s.fullmatch(token)) for s in _SHAPES), 13 <= len(d) <= 19 and luhn(d), token.startswith("+"), before[-1:] in ("=", ":") or before in ("=", ":"), *(bool(near & words) for words in _TRIGGERS.values())]
    return np.array(values, float)


def _similar(token: str) -> str:
    """What similar tokens share: the mail domain, or six digits and more."""
    if "@" in token[1:]:
        return "@" + token.rsplit("@", 1)[1].lower()
    d = _digits(token)
    return d if len(d) >= 6 else ""


def _examples(rng: random.Random) -> list[tuple[int, str, str, str, int]]:
    """(label, token, word before, word before that, label of a similar token elsewhere,
    -1 without one). Similar tokens mostly agree; some of each kind don't."""
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8)))
    num = lambda a, b: "".join(rng.choice("0123456789") for _ in range(rng.randint(a, b)))
    hexa = lambda a, b: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(a, b)))
    mixed = lambda a, b: "".join(rng.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(rng.randint(a, b)))

    def card():
        d = num(15, 15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    trigger = lambda kind: rng.choice(sorted(_TRIGGERS[kind]))
    out = []
    for turn in range(150):
        plain = (word(), word())
        out += [
            ("email", f"{word()}{num(0, 2)}@{word()}.com", *plain, None),
            ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4)), *rng.choice([plain, (trigger("ip"), word())]), None),
            ("card", card(), *rng.choice([plain, (trigger("card"), word())]), None),
            ("phone", f"+{num(9, 13)}", *plain, None),
            ("phone", f"{num(3, 3)}-{num(3, 3)}-{num(4, 4)}", rng.choice(["tel:", "phone:", "fax"]), word(), None),
            ("secret", hexa(32, 64), *rng.choice([("=", trigger("secret")), plain]), None),
            ("secret", mixed(20, 40), "=", trigger("secret"), None),
            ("secret", mixed(12, 40), *plain, "secret"),
            ("secret", mixed(12, 18), f"{trigger('secret')}:", word(), None),
            ("id", f"{num(3, 3)}-{num(2, 2)}-{num(4, 4)}", *rng.choice([plain, ("ssn", word())]), None),
            ("id", f"DE{num(20, 20)}", *rng.choice([plain, ("iban", word())]), None),
            ("", num(1, 4), *plain, None),
            ("", num(5, 12), *plain, None),
            ("", "1" + num(12, 18), *plain, None),
            ("", f"{num(1, 2)}.{num(1, 2)}", "version", word(), None),
            ("", f"{num(1, 2)}.{num(1, 2)}.{num(1, 2)}", *plain, None),
            ("", f"{num(4, 4)}-{num(2, 2)}-{num(2, 2)}", *plain, None),
            ("", f"{num(1, 2)}:{num(2, 2)}", "at", word(), None),
            ("", f"{word()}{num(1, 3)}", *plain, None),
            ("", mixed(12, 19), *plain, None),
            ("", mixed(20, 30), *plain, None),
            ("", f"${num(1, 4)}.{num(2, 2)}", *plain, None),
            ("", f"@{word()}", *plain, None),
            ("", f"https://{word()}.com/{num(1, 5)}", *plain, None),
            ("", f"({num(3, 3)})", *plain, None),
            ("", rng.choice([num(1, 6), f"{word()}{num(1, 3)}", mixed(12, 19)]), f"{word()}{rng.choice('=:')}", word(), None),
            ("", num(1, 5), f"{trigger('secret')}{rng.choice('=:')}", word(), None),
        ]
        if turn % 10 == 0:  # a likeness that misleads
            out += [
                ("", mixed(12, 19), *plain, "secret"),
                ("secret", mixed(20, 40), "=", trigger("secret"), ""),
                ("", num(6, 9), *plain, "phone"),
                ("phone", f"+{num(9, 13)}", *plain, ""),
                ("email", f"{word()}{num(0, 2)}@{word()}.com", *plain, ""),
                ("", f"@{word()}", *plain, "email"),
            ]
        if turn % 2 == 0:
            out += [
                ("email", f"{word()}{num(0, 2)}@{word()}.com", *plain, "email"),
                ("phone", f"{num(3, 3)}-{num(3, 3)}-{num(4, 4)}", *plain, "phone"),
                ("", num(6, 9), *plain, ""),
                ("id", f"{num(3, 3)}-{num(2, 2)}-{num(4, 4)}", *plain, "id"),
            ]
    return [(LABELS.index(kind), *rest, -1 if like is None else LABELS.index(like)) for kind, *rest, like in out]


def _sequences(rng: random.Random, examples: list) -> list[list[tuple[int, str, str, str, int]]]:
    """Chains of nodes as in ``_examples``, with no word between them."""
    num = lambda a, b: "".join(rng.choice("0123456789") for _ in range(rng.randint(a, b)))
    word = lambda: "".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 8)))
    out = []

    def close(labels, tokens, before):
        words = [*before, *tokens]
        out.append([(LABELS.index(k), t, words[i + 1], words[i], -1) for i, (k, t) in enumerate(zip(labels, tokens))])

    for _ in range(100):
        plain = (word(), word())
        iban = [rng.choice(["DE", "FR", "ES", "GB", "NL"]) + num(2, 2), *(num(4, 4) for _ in range(rng.randint(3, 6))), num(1, 3)]
        close(["id"] * len(iban), iban, rng.choice([plain, (word(), "iban"), (word(), "iban:"), ("iban", ":")]))
        phone = [rng.choice([num(3, 5), f"({num(3, 3)})"]), *(num(2, 4) for _ in range(rng.randint(1, 3)))]
        close(["phone"] * len(phone), phone, (word(), rng.choice(["tel:", "phone:", "phone", "tel", "fax", "call"])))
        for _ in range(3):
            close([""] * len(t := [num(1, 4) for _ in range(rng.randint(2, 7))]), t, plain)
        close(["", "", ""], [f"{num(4, 4)}-{num(2, 2)}-{num(2, 2)}", f"{num(1, 2)}:{num(2, 2)}", num(1, 3)], plain)
        close(["ip", ""], [".".join(str(rng.randint(0, 255)) for _ in range(4)), num(2, 4)], plain)
        out.append([rng.choice(examples), rng.choice(examples)])
    return out


def trained(seed: int = 5, steps: int = 400) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the potentials, the weight of two linked nodes' agreement, and the
    transitions (label, next label), by gradient ascent on the likelihood of the
    chains, given the labels of linked nodes."""
    rng = random.Random(seed)
    examples = _examples(rng)
    sequences = [[e] for e in examples] + _sequences(rng, examples)
    nodes = [e for chain in sequences for e in chain]
    x = np.array([features(t, a, b) for _, t, a, b, _ in nodes])
    # the label of a similar token is given; agreeing with it is worth ``c``
    like = np.array([np.eye(len(LABELS))[e[4]] if e[4] >= 0 else np.zeros(len(LABELS)) for e in nodes])
    one = np.eye(len(LABELS))[[e[0] for e in nodes]]
    # places of the nodes of chains longer than one, padded at the end
    alone = len(examples)
    long = sequences[alone:]
    there = np.array([[i < len(chain) for i in range(max(map(len, long)))] for chain in long])
    padded = np.zeros((*there.shape, len(LABELS)))
    padded[there] = one[alone:]
    truth = np.einsum("nta,ntb->ab", padded[:, :-1], padded[:, 1:])
    w, c, move = np.zeros((x.shape[1], len(LABELS))), 0.0, np.zeros((len(LABELS), len(LABELS)))
    dw, dc, dmove = 0.0 * w, 0.0, 0.0 * move
    for _ in range(steps):
        z = x @ w + c * like
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        own, e = np.ones(padded.shape), np.exp(move)
        own[there] = p[alone:]
        forth, later = [own[:, 0]], [np.ones(own[:, 0].shape)]
        for t in range(1, own.shape[1]):
            f = (forth[-1] @ e) * own[:, t]
            forth.append(f / f.sum(axis=1, keepdims=True))
            u = own.shape[1] - t
            g = (own[:, u] * later[0]) @ e.T
            later.insert(0, np.where(there[:, u, None], g / g.sum(axis=1, keepdims=True), 1.0))
        both = np.stack(forth, 1) * np.stack(later, 1)
        p[alone:] = (both / both.sum(axis=2, keepdims=True))[there]
        pairs = np.zeros_like(move)
        for t in range(own.shape[1] - 1):
            on = there[:, t + 1]
            q = forth[t][on][:, :, None] * e * (own[on, t + 1] * later[t + 1][on])[:, None, :]
            pairs += (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        off = one - p
        dw = 0.9 * dw + 0.5 * (x.T @ off / len(x) - 1e-4 * w)
        dc = 0.9 * dc + 0.5 * (float((like * off).sum()) / len(x) - 1e-4 * c)
        dmove = 0.9 * dmove + 0.5 * ((truth - pairs) / len(x) - 1e-4 * move)
        w, c, move = w + dw, c + dc, move + dmove
    return w, c, move


def _through_hub(agree: float) -> float:
    """The agreement of nodes with a hub that makes two nodes agree as a direct link does."""
    gain = np.expm1(agree)
    return float(np.log1p(gain + np.sqrt(gain * gain + len(LABELS) * gain)))


def marginals(unary: np.ndarray, edges: list[tuple[int, int]], agree: np.ndarray, chain: list[int] = (), move: np.ndarray | None = None, rounds: int = 200) -> np.ndarray:
    """Beliefs (log) after loopy sum-product message passing with damping, until nothing
    changes. The pair potential of ``edges`` is ``agree`` (each its own) for equal
    labels and 0 for others; nodes i and i + 1 have the transitions ``move`` for every i of ``chain``."""
    n, follow = len(edges), len(chain)
    if not n + follow:
        return unary
    pairs = [*edges, *((i, i + 1) for i in chain)]
    a, b = (np.array([*(e[i] for e in pairs), *(e[1 - i] for e in pairs)]) for i in (0, 1))
    half = len(pairs)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    skip = np.concatenate([np.arange(n), np.arange(half, half + n)])
    onward = [(half * side + n + np.arange(follow), np.exp(move.T if side else move)) for side in (0, 1)] if follow else []
    message = np.zeros((2 * half, unary.shape[1]))
    gain = np.expm1(np.tile(agree, 2))[:, None]
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, b, message)
        out = belief[a] - message[back]
        out -= out.max(axis=1, keepdims=True)
        e = np.exp(out)
        new = np.empty_like(e)
        new[skip] = e[skip].sum(axis=1, keepdims=True) + gain * e[skip]
        for of, m in onward:
            new[of] = e[of] @ m
        new = np.log(new)
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - message).max() < 1e-4:
            break
        message = 0.5 * message + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, b, message)
    return belief


#: Agreement of occurrences of one token: they are one thing, so that what the token
#: itself says, which only the hub has, outweighs any words before one of them.
SAME = 20.0


def _hubs(tokens: list[str], taken: list[str], unary: np.ndarray, own: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Potentials with those of the hubs behind them, and the links: all occurrences of
    a token to one hub, and hubs (or single tokens) of similar tokens to another. No
    occurrence is more than four links from another, and links grow with the nodes only.
    ``own`` is what the potentials have from the token alone: it is the same evidence
    in each occurrence, so it counts once, in the hub."""
    places: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        places.setdefault(token.lower(), []).append(i)
    unary, more, edges = unary.copy(), [], []
    alike: dict[str, list[int]] = {}
    for token, at in places.items():
        hub = at[0]
        if len(at) > 1:
            hub = len(unary) + len(more)
            free = [i for i in at if not taken[i]]
            more.append(own[free[0]] if free else np.zeros(unary.shape[1]))
            known = set()
            for i in free:
                # the same words before it again are no new evidence either
                unary[i] = 0.0 if contexts[i] in known else unary[i] - own[i]
                known.add(contexts[i])
            edges.extend((hub, i) for i in at)
        if key := _similar(token):
            alike.setdefault(key, []).append(hub)
    n_same = len(edges)
    for members in alike.values():
        if len(members) > 1:
            hub = len(unary) + len(more)
            more.append(np.zeros(unary.shape[1]))
            edges.extend((hub, i) for i in members)
    return np.concatenate([unary, np.array(more).reshape(-1, unary.shape[1])]), edges, np.arange(len(edges)) < n_same


def _pieces(word: str) -> list[tuple[int, str, str]]:
    """(offset, piece, mark) of a word cut at = : quotes, brackets and commas, and the
    address of a page at ? and & as well; the mark is the = or : after the piece. Times,
    numbers and the like stay whole."""
    left = len(word) - len(word.lstrip(_EDGE))
    core = word[left:].rstrip(_EDGE)
    if _WHOLE.fullmatch(core):
        return [(left, core, "")]
    out, at, cuts = [], left, _CUTS
    if (page := _PAGE.match(word, left)) is not None:
        out.append((left, page[0], ""))
        at, cuts = page.end(), _PAGE_CUTS
    for m in cuts.finditer(word, at):
        if m.start() > at:
            out.append((at, word[at : m.start()], next((c for c in m[0] if c in "=:"), "")))
        at = m.end()
    return [*out, (at, word[at:], "")] if at < len(word) else out


def _contexts(word: str) -> list[str]:
    return [piece + mark for _, piece, mark in _pieces(word)] or [word]


def _apart(base: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """Base spans in order, the parts of later ones that overlap left out."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base):
        if b > end:
            out.append((max(a, end), b, kind))
            end = b
    return out


def _before(text: str, at: int) -> list[str]:
    """The last two words before a place, whole however long they are."""
    size = 80
    while True:
        part = text[max(0, at - size) : at]
        words = part.split()
        if size >= at or len(words) > 2 or (len(words) == 2 and part[0].isspace()):
            return words[-2:]
        size *= 4


def field_spans(text: str, base: list[tuple[str, int, int]], model: tuple[np.ndarray, float, np.ndarray]) -> list[tuple[str, int, int]]:
    """What the field labels beside the base; the parts of tokens in base spans are its."""
    if not _ANY.search(text):
        return []
    held = _apart(base)
    nodes, taken, seen, j = [], [], {}, 0
    for m in _TOKEN.finditer(text):
        near = [x for word in _before(text, m.start()) for x in _contexts(word)]
        for at, piece, mark in _pieces(m[0]):
            before, before2 = (near[-1] if near else ""), (near[-2] if len(near) > 1 else "")
            near = [*near[-1:], piece + mark]
            start, end = m.start() + at, m.start() + at + len(piece)
            while j < len(held) and held[j][1] <= start:
                j += 1
            parts, k = [], j
            while k < len(held) and held[k][0] < end:
                parts += [(start, held[k][0], ""), (max(start, held[k][0]), min(end, held[k][1]), held[k][2])]
                start, k = held[k][1], k + 1
            for a, b, kind in [*parts, (start, end, "")]:
                token = text[a:b]
                if not kind:
                    token = token.lstrip(_EDGE)
                    a, token = b - len(token), token.rstrip(_EDGE)
                if not _ANY.search(token):
                    continue
                if (key := (token, before, before2)) not in seen:
                    seen[key] = features(token, before, before2)
                nodes.append((a, a + len(token), token, seen[key]))
                taken.append(kind)
    if not nodes:
        return []
    w, agree, move = model
    x = np.array([n[3] for n in nodes])
    unary, own = x @ w, x[:, :OF_TOKEN] @ w[:OF_TOKEN]
    unary -= unary.max(axis=1, keepdims=True)
    for i, kind in enumerate(taken):
        if kind:  # observed
            unary[i] = -30.0
            unary[i, LABELS.index(kind)] = 0.0
    linked, edges, same = _hubs([n[2] for n in nodes], taken, unary, own, [r.tobytes() for r in x[:, OF_TOKEN:]])
    # with words between them nodes follow each other by chance: their transitions are none
    chain = [i for i, (x, y) in enumerate(zip(nodes, nodes[1:])) if y[0] - x[1] <= 4 and not _LETTER.search(text, x[1], y[0])]
    best = marginals(linked, edges, np.where(same, SAME, _through_hub(agree)), chain, move)[: len(nodes)].argmax(axis=1)
    return [(LABELS[k], a, b) for k, (a, b, _, _), held_by in zip(best.tolist(), nodes, taken) if k and not held_by]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind:start:end, comma-joined) and spans (all, likewise)."""
    model = trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                base, every = [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    own = base_spans(text)
                    more = field_spans(text, own, model)
                    base.append(_joined(own))
                    every.append(_joined(own + more) if more else base[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, base string, spans string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detected(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2("base", 256).alias("base_sha256"), "spans")
