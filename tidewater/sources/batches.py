"""Batch scripts: epochs as text, for tests and replays.

    batch
    + edge 1 2
    - edge 2 3        # removals only of @differential messages
    end
"""

from __future__ import annotations

from tidewater.lang.ast import DatalogError
from tidewater.plans.database import Database

Batch = dict[str, tuple[list[tuple], list[tuple]]]


def parse_batches(text: str, db: Database) -> list[Batch]:
    """The epochs of a script, values checked against the width of their column."""
    out: list[Batch] = []
    now: Batch | None = None
    for n, line in enumerate(text.splitlines(), 1):
        words = line.partition("#")[0].split()
        if not words:
            continue
        if words == ["batch"] and now is None:
            now = {}
        elif words == ["end"] and now is not None:
            out.append(now)
            now = None
        elif words[0] in ("+", "-") and now is not None and len(words) > 1:
            rel = db.program.relations[db.program.key_of(words[1])]
            if len(words) - 2 != len(rel.types):
                raise DatalogError(f"{words[1]} takes {len(rel.types)} values", (n, 1))
            row = tuple(_value(w, t, n) for w, t in zip(words[2:], rel.types, strict=True))
            now.setdefault(words[1], ([], []))[words[0] == "-"].append(row)
        else:
            raise DatalogError(f"Unexpected {line.strip()!r}", (n, 1))
    if now is not None:
        raise DatalogError("The last batch has no end", (len(text.splitlines()), 1))
    return out


def _value(word: str, kind: str | None, line: int):
    if kind == "bool":
        if word not in ("true", "false", "1", "0"):
            raise DatalogError(f"{word} is not a bool", (line, 1))
        return word in ("true", "1")
    if kind in ("f32", "f64"):
        return float(word)
    if kind and kind[0] in "iu" and kind[1:].isdigit():
        v, bits = int(word, 0), int(kind[1:])
        low, high = (0, (1 << min(bits, 63)) - 1) if kind[0] == "u" else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
        if not low <= v <= high:
            raise DatalogError(f"{word} is out of the range of {kind}", (line, 1))
        return v
    return word


def run_batches(text: str, db: Database) -> None:
    """Send a script, one epoch a batch."""
    for b in parse_batches(text, db):
        db.batch({k: (a, r or None) for k, (a, r) in b.items()})
