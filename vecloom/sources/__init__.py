"""Where records come from and go to: operation logs, snapshots, JSON files."""
