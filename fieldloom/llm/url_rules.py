"""URL filters: all glob rules run at once as one bit-parallel automaton.

Rules are globs over the canonical URL: ``*`` matches any run of characters, ``?`` one
character. Each rule takes one bit for its start and one for each character or ``?``; bits
of all rules are packed into 64-bit words. With ``D`` the active states, a byte ``c`` gives

    D = ((D << 1) & ADVANCE[c]) | (D & STAY[c])

where the shift carries from word to word, ``ADVANCE[c]`` has the bits that ``c`` may enter
and ``STAY[c]`` those that a following ``*`` (or the rest of a UTF-8 character after ``?``)
keeps active. A start bit is never entered, so no rule leaks into the next. The automaton
runs over a column of URLs at a time, sorted by length, position by position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.textbytes import slices

#: Bytes of automaton states and of results that a task holds at a time: the more rules, the fewer URLs.
STATES = 16 << 20

#: Rules that begin with ``@`` are exceptions: a URL that matches one isn't blocked.
RULES = (
    "*://*casino*/*", "*://*free-bets*/*", "*://*cheap-pills*/*", "*://*ads-track*/*", "*://ads.*/*", "*://*.doubleclick.*/*",
    "*://*poker*.*/*", "*://*adult*.*/*", "*://*.xxx/*", "*://*payday-loan*/*", "*://*torrent*/*", "*://*/wp-admin/*",
    "*://*/cgi-bin/*", "*://*/login*", "*://*/signup*", "*://*/cart?*", "*://*/checkout*", "*.jpg", "*.jpeg", "*.png", "*.gif",
    "*.zip", "*.exe", "*.mp?", "*.tar.gz", "*://*/feed/", "*://*/tag/*/page/*", "*?*session*id=*", "*?*replytocom=*", "*://localhost*",
    "*://127.*", "*://10.*", "*://192.168.*", "ftp://*", "mailto:*", "javascript:*", "data:*", "*://*.onion/*",
    "@*://*casino*/*/responsible-gaming*", "@*://m.ththth.example.net/*",
)

_STEPS = (
    # pattern, replacement; over the whole URL once scheme and host are lower case
    (r"^(http://[^/?]*):80([/?]|$)", r"$1$2"),
    (r"^(https://[^/?]*):443([/?]|$)", r"$1$2"),
    (r"([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*", r"$1"),
    (r"&&+", "&"),
    (r"[?]&+", "?"),
    (r"[?&]+$", ""),
    (r"^([a-z][a-z0-9+.-]*://[^/?]+)$", r"$1/"),
    (r"^([a-z][a-z0-9+.-]*://[^/?]+)[?]", r"$1/?"),
)
_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)"


def canonical(url: Column) -> Column:
    """Ends trimmed, no fragment, scheme and host in lower case, no default port or tracking parameter, a path."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(u, _HEAD, 1)
    u = F.concat(F.lower(head), F.substring(u, F.length(head) + 1, F.length(u)))
    for pattern, to in _STEPS:
        u = F.regexp_replace(u, pattern, to)
    return u


class GlobAutomaton:
    """The packed automaton of some globs."""

    def __init__(self, globs: Sequence[str]):
        tokens = [[t for t in _tokens(g)] for g in globs]
        bits = sum(1 + sum(t != "*" for t in g) for g in tokens)
        self.words = max(1, -(-bits // 64))
        self.advance = np.zeros((256, self.words), dtype=np.uint64)
        self.stay = np.zeros((256, self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.final: list[tuple[int, int]] = []
        at = -1
        for g in tokens:
            at += 1
            self.start[at >> 6] |= np.uint64(1 << (at & 63))
            for t in g:
                if t == "*":
                    self.stay[:, at >> 6] |= np.uint64(1 << (at & 63))
                    continue
                at += 1
                w, b = at >> 6, np.uint64(1 << (at & 63))
                if t is None:
                    self.advance[:128, w] |= b
                    self.advance[0xC0:, w] |= b
                    self.stay[0x80:0xC0, w] |= b
                else:
                    self.advance[t, w] |= b
            self.final.append((at >> 6, at & 63))

    def match(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each glob."""
        n = len(offs) - 1
        order = np.argsort(offs[:-1] - offs[1:], kind="stable")
        begin, length = offs[:-1][order], np.diff(offs)[order]
        d = np.repeat(self.start[None, :], n, axis=0)
        for j in range(int(length[0]) if n else 0):
            live = int(np.searchsorted(-length, -j, side="left"))
            c = data[begin[:live] + j]
            x = d[:live]
            shifted = x << np.uint64(1)
            shifted[:, 1:] |= x[:, :-1] >> np.uint64(63)
            d[:live] = (shifted & self.advance[c]) | (x & self.stay[c])
        out = np.zeros((n, len(self.final)), dtype=bool)
        for k, (w, b) in enumerate(self.final):
            out[order, k] = (d[:, w] >> np.uint64(b)) & np.uint64(1) == 1
        return out


def _tokens(glob: str) -> Iterator[int | str | None]:
    for ch in glob:
        if ch == "?":
            yield None
        elif ch == "*":
            yield "*"
        else:
            yield from ch.encode()


def filter_urls(pages: DataFrame, rules: Sequence[str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, canonical_url, rules, blocked)``, a row for each row of ``pages``.

    ``rules`` has the numbers of all rules that match, joined by commas; ``blocked`` is true
    if a rule matches and no exception does.

    * null URL: null canonical URL, no rules, not blocked; empty URL: only rules that match
      the empty string (``*``);
    * no rules: nothing is blocked; null identifiers and repeated rows pass as they are;
    * URLs of any length are matched whole; other columns are ignored; memory is bounded by
      ``STATES`` whatever the number of rules; an empty table gives an empty result.
    """
    df = pages.select(F.col(id_col).alias("page_id"), canonical(F.col(url_col)).alias("canonical_url"))
    automaton = GlobAutomaton([r.removeprefix("@") for r in rules])
    at_once = max(1, STATES // (24 * automaton.words + len(rules)))  # states, two temporaries and a truth value for each rule
    allow = np.array([r.startswith("@") for r in rules], dtype=bool)
    kind = df.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1), rows=at_once):
                hit = automaton.match(data, offs)
                hit &= batch.column(1)[lo:hi].is_valid().to_numpy(zero_copy_only=False)[:, None]
                names = [""] * (hi - lo)
                for i in np.flatnonzero(hit.any(axis=1)):
                    names[i] = ",".join(map(str, np.flatnonzero(hit[i])))
                blocked = hit[:, ~allow].any(axis=1) & ~hit[:, allow].any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(names, pa.string()), pa.array(blocked)],
                    ["page_id", "canonical_url", "rules", "blocked"],
                )

    return df.mapInArrow(run, f"page_id {kind}, canonical_url string, rules string, blocked boolean")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    u = "low"
    for pattern, to in _STEPS:
        u = f"regexp_replace({u}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    rows = ", ".join(f"({i}, {q(r.removeprefix('@'))}, {str(r.startswith('@')).lower()})" for i, r in enumerate(RULES))
    return f"""
WITH p AS (SELECT page_id, regexp_replace(trim(url, ' '), '#.*$', '') AS u FROM pages),
h AS (SELECT page_id, u, regexp_extract(u, {q(_HEAD)}, 1) AS head FROM p),
c AS (SELECT page_id, lower(head) || substr(u, length(head) + 1) AS low FROM h),
k AS (SELECT row_number() OVER () AS n, page_id, {u} AS canonical_url FROM c),
r(i, pattern, allow) AS (VALUES {rows}),
m AS (
  SELECT n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rules, bool_or(NOT allow) AND NOT bool_or(allow) AS blocked
  FROM k JOIN r ON k.canonical_url GLOB r.pattern GROUP BY n
)
SELECT page_id, canonical_url, coalesce(rules, '') AS rules, coalesce(blocked, false) AS blocked FROM k LEFT JOIN m USING (n)
"""


SQL = _sql()
