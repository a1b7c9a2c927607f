"""Small tables for the corpus operators: nulls, empties, ties, repeats, clashing names."""

from __future__ import annotations

import random
import re
import zlib

SYLLABLES = {"en": "the th er on an re he in ed nd ha at en es of or nt ea ti".split(), "de": "der die und ein sch en ge be ung ver zu ich tz pf".split(), "fr": "le la les de eau ou oi ai eux que qu tion ment re".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, lang: str, n: int) -> str:
    s = SYLLABLES[lang]
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, n: int = 120, seed: int = 3, rows: list | None = None):
    rng = random.Random(seed)
    if rows is None:
        rows = []
        for i in range(n):
            lang = rng.choice(sorted(SYLLABLES))
            rows.append((i, prose(rng, lang, rng.choice([1, 3, 10, 60, 200])), lang))
        base = rows[5][1]
        rows += [(n, base, "en"), (n + 1, base + " extra", None), (n + 2, None, "en"), (n + 3, "", "de"), (n + 4, "  \n\t ", "fr"), (n + 5, "123 !? 45", "en"), (n + 6, "the " * 30000, "en"), (None, "the end", "en"), (n + 7, "The THE the", "en"), (n + 7, "The THE the", "en")]
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t, lang in rows], SCHEMA)


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[ \t-\r]+", low) if w]


def held_out(doc_id, mod: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod == 0
