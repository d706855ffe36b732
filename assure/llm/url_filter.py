"""URL filters: glob rules simulated together by a bit-parallel Shift-And automaton.

All patterns are packed, one bit a position, into as many 64-bit words as they need. One step for one
character is D = (((D << 1) & B[c]) | (D & L[c])): B has the positions that read c, L those that may loop
on it (the wildcards). A batch of URLs goes through numpy as a matrix, so a step serves all its URLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


#: The rules with a stated verdict.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: What the method blocks where no rule fits. `*` stands for any run without a slash, `**` for any run.
BLOCKED_GLOBS = (
    "**casino**", "**porn**", "**xxx**", "**poker**", "**viagra**", "**betting**",
    "ads.**", "*.ads.**", "**/ads/**", "**doubleclick.**", "**/wp-login**", "**/cart/**", "**/checkout/**",
    "**.exe", "**.zip", "**.jpg", "**.png", "**.gif", "**.mp4", "**.pdf",
)


class Automaton:
    """The packed masks of a list of globs."""

    def __init__(self, globs: list[str]):
        bits = 0
        reads: list[tuple[int, int]] = []  # position, byte
        loops: list[tuple[int, bool]] = []  # position, also on a slash
        starts, ends = [], []
        for glob in globs:
            starts.append(bits)
            at = bits
            for part in re.findall(rb"\*+|[^*]", glob.encode()):
                if part.startswith(b"*"):
                    loops.append((at, len(part) > 1))
                else:
                    at += 1
                    reads.append((at, part[0]))
            ends.append(at)
            bits = at + 1
        self.words = -(-bits // 64)
        zero = lambda: np.zeros((self.words, 256), np.uint64)
        self.read, self.loop = zero(), zero()
        for at, c in reads:
            self.read[at // 64, c] |= np.uint64(1 << at % 64)
        for at, slash in loops:
            keep = np.arange(256) != ord("/")
            self.loop[at // 64, slash | keep] |= np.uint64(1 << at % 64)
        self.start = np.zeros(self.words, np.uint64)
        for at in starts:
            self.start[at // 64] |= np.uint64(1 << at % 64)
        self.ends = ends

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text and a column for each glob: whether the whole text fits."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for k in range(0, len(order), 4096):
            self._run(texts, order[k : k + 4096], out)
        return out

    def _run(self, texts: list[bytes], rows: list[int], out: np.ndarray) -> None:
        lengths = np.array([len(texts[i]) for i in rows])
        state = np.repeat(self.start[:, None], len(rows), 1)
        one, top = np.uint64(1), np.uint64(63)
        width = 256  # of the matrix at a time, so that one very long URL doesn't widen all rows
        for left in range(0, int(lengths.max(initial=0)), width):
            n = int((lengths > left).sum())  # rows come longest first
            chars = np.zeros((n, width), np.uint8)
            for j, i in enumerate(rows[:n]):
                part = texts[i][left : left + width]
                chars[j, : len(part)] = np.frombuffer(part, np.uint8)
            for t in range(min(width, int(lengths[0]) - left)):
                m = int((lengths > left + t).sum()) if lengths[n - 1] <= left + t else n
                now, c = state[:, :m], chars[:m, t]
                moved = now << one
                moved[1:] |= now[:-1] >> top
                state[:, :m] = (moved & self.read[:, c]) | (now & self.loop[:, c])
        for p, at in enumerate(self.ends):
            out[rows, p] = (state[at // 64] >> np.uint64(at % 64)) & one != 0


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty without a `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = re.search(r"[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url).

    A null url, or one without `://`, has an empty host and path and no rule; the globs then see an empty
    string, so it is allowed. Repeated rows give repeated results, an empty table an empty one; other
    columns are ignored. Of the rules that fit, the longest wins; without one, any glob that fits blocks.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs()] + list(blocked)
    machine: list[Automaton] = []

    def of_batch(batch: pa.RecordBatch) -> dict:
        if not machine:
            machine.append(Automaton(globs))
        split = [parts(u.as_py()) for u in batch.column("url")]
        hit = machine[0].matches([(h + p).encode("utf-8", "surrogatepass") for h, p in split])
        k = len(ranked)
        by_rule = hit[:, : 2 * k].reshape(-1, k, 2).any(2)
        first = np.where(by_rule.any(1), by_rule.argmax(1), -1) if k else np.full(len(split), -1)
        bad = hit[:, 2 * k :].any(1)
        return {
            "page_id": batch.column("page_id"),
            "host": [h for h, _ in split],
            "path": [p for _, p in split],
            "rule": [ranked[i].name if i >= 0 else None for i in first],
            "verdict": [ranked[i].verdict if i >= 0 else "block" if b else "allow" for i, b in zip(first, bad)],
        }

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return arrow_map(rows, of_batch, "page_id long, host string, path string, rule string, verdict string")


def sql(rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED_GLOBS) -> str:
    """judge() over the view pages, for DuckDB."""
    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(rules, key=lambda r: -len(r.name))
    )
    verdicts = "\n".join(f"    WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in rules)
    parts_of = {"**": ".*", "*": "[^/]*"}
    globs = "|".join("".join(parts_of.get(x, re.escape(x)) for x in re.findall(r"\*+|[^*]", g)) for g in blocked)
    letters = "".join(map(chr, range(65, 91)))
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{letters}', '{letters.lower()}') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
{fits}
  END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
{verdicts}
    WHEN regexp_full_match(host || path, '(?s)(?:{globs})') THEN 'block' ELSE 'allow'
  END AS verdict
FROM r
"""
