"""Byte-level BPE: a DuckDB recursion contracts words, an ordered aggregation decodes them.

Per partition, each distinct word (a match of the splitting pattern) is encoded once. Its
token-position rows join the merge table; each step contracts every unfinished word's leftmost pair
of lowest rank; words without a pair leave the recursion. Decoding joins the ids to the vocabulary
and concatenates their bytes in order. Texts never enter DuckDB, so its memory is bounded by
WORDS words at a time.

Words of more than LONG bytes are first cut between bytes that stand side by side in no token: no merge goes over such
a place. Parts that are still long have a recursion of their own, which keeps one row for each token and contracts, in a step, all
pairs of the lowest rank from the left up to the first whose contraction makes a pair of lower rank: one after another
they would be contracted just so.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from inkflow.llm import vocab
from inkflow.llm.common import lean, rows_of, table, texts

#: Distinct words (and bytes of words) that one DuckDB call encodes.
WORDS, WORD_BYTES = 100_000, 2 << 20
#: Words of more bytes are cut, and what is still longer has a recursion of its own; words of more bytes aren't kept.
LONG, KEEP = 64, 1024
#: Bytes of text that are split at once.
PORTION = 8 << 20
#: Encoded words that a worker keeps from one portion of texts to the next.
KEPT = 600_000

#: p: a byte's place in all words together; n: the place of the next token of its word, or -1.
ENCODE = """
with recursive step(w, p, n, t, fin) as (
    select w, p, n, t, false from start
    union all (
        with cur as (select * from step where not fin),
        pair as (select a.w, (m.k::bigint << 32) | a.p as v, b.p as gone, b.n from cur a join cur b on b.p = a.n join merges m on m.l = a.t and m.r = b.t),
        best as (select w, min(v) as v, arg_min(gone, v) as gone, arg_min(n, v) as n from pair group by w),
        hit as (select w, (v >> 32)::int as k, (v & 4294967295)::int as p, gone, n from best)
        select c.w, c.p, case when c.p = h.p then h.n else c.n end, case when c.p = h.p then h.k else c.t end, h.w is null
        from cur c left join hit h on h.w = c.w where c.p is distinct from h.gone
    )
)
select w, p, t from step where fin
"""
#: The same for long words. q: the place of the token before, or -1; k: the rank of the pair with the next one. Tokens that are gone have no t.
ENCODE_LONG = """
with recursive s(p, w, n, q, t, k) using key (p) as (
    select a.p, a.w, a.n, a.q, a.t, m.k from start a left join start b on b.p = a.n left join merges m on m.l = a.t and m.r = b.t
    union (
        with best as (select w, min(k) as r from recurring.s where k is not null group by w),
        hit as (select s.p, s.w, s.n, s.q, best.r, lag(s.n) over (partition by s.w order by s.p) as before from recurring.s s join best on best.w = s.w and best.r = s.k),
        -- Of pairs that overlap in a row, every second one goes.
        row_ as (select *, sum(case when before = p then 0 else 1 end) over (partition by w order by p) as i from hit),
        turn as (select *, row_number() over (partition by w, i order by p) as place from row_),
        chosen as (select p, w, n as gone, q, r, lag(p) over (partition by w order by p) as lp, lag(n) over (partition by w order by p) as lgone from turn where place % 2 = 1),
        around as (
            select c.*, g.n as nn, x.t as xt, x.n as xn, x.k as xk, y.t as yt, y.q as yq, case when c.lgone = c.q then c.r else y.t end as lt
            from chosen c join recurring.s g on g.p = c.gone left join recurring.s x on x.p = g.n left join recurring.s y on y.p = c.q
        ),
        early as (select a.w, min(a.p) as cut from around a left join merges u on u.l = a.lt and u.r = a.r left join merges v on v.l = a.r and v.r = a.xt where u.k < a.r or v.k < a.r group by a.w),
        done as (
            select a.*, lead(a.p) over (partition by a.w order by a.p) as np, lead(a.q) over (partition by a.w order by a.p) as nq, lag(a.nn) over (partition by a.w order by a.p) as lnn
            from around a left join early e on e.w = a.w where e.cut is null or a.p <= e.cut
        )
        select d.p, d.w, d.nn, case when d.lgone = d.q then d.lp else d.q end, d.r, m.k
        from done d left join merges m on m.l = d.r and m.r = (case when d.np = d.nn then d.r else d.xt end)
        union all select d.gone, d.w, null, null, null, null from done d
        union all
        select d.q, d.w, d.p, case when d.lnn = d.q then d.lp else d.yq end, d.yt, m.k
        from done d left join merges m on m.l = d.yt and m.r = d.r where d.q >= 0 and d.lgone is distinct from d.q
        union all
        select d.nn, d.w, d.xn, d.p, d.xt, d.xk from done d where d.nn >= 0 and d.np is distinct from d.nn and d.nq is distinct from d.nn
    )
)
select w, p, t from s where t is not null
"""
IDS, IDS_LONG = (f"create or replace temp table ids as {x}" for x in (ENCODE, ENCODE_LONG))
#: Ordered aggregation: the ids as text, and the bytes that they stand for, as Latin-1 characters.
DECODE = """
select string_agg(ids.t::varchar, ' ' order by p) as ids, string_agg(h, '' order by p) as back
from ids join vocabulary on vocabulary.t = ids.t group by w order by w
"""


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, rank) for all pairs of tokens whose bytes together are a token.

    As ranks belong to bytes and not to pairs, every split of a token into two tokens counts.
    """
    return [(left, right, k) for token, k in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]


class Codec:
    """One DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, path: str):
        ranks = vocab.ranks(path)
        # Only an extremely long part can need more: it spills to the worker's own temporary folder.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": f"{tempfile.gettempdir()}/inkflow-duckdb-{os.getpid()}"})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.beside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            self.beside[list(token[:-1]), list(token[1:])] = True
        self._table("merges", {k: pa.array(v, pa.int32()) for k, v in zip("lrk", zip(*merge_table(ranks), strict=True), strict=True)})
        self._table("vocabulary", {"t": pa.array(ranks.values(), pa.int32()), "h": [k.decode("latin-1") for k in ranks]})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as from given")
        self.db.unregister("given")

    def words(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Each word's ids as text, and the bytes they decode to as Latin-1 characters."""
        cut = [self._cut(w.encode()) for w in words]
        parts = list(dict.fromkeys(p for word in cut for p in word))
        found: dict[bytes, tuple[str, str]] = {}
        for long, statement in ((False, IDS), (True, IDS_LONG)):
            chosen = [p for p in parts if (len(p) > LONG) == long]
            if chosen:
                found.update(zip(chosen, self._encode(chosen, statement), strict=True))
        return [" ".join(found[p][0] for p in word) for word in cut], ["".join(found[p][1] for p in word) for word in cut]

    def _cut(self, word: bytes) -> list[bytes]:
        if len(word) <= LONG:
            return [word]
        data = np.frombuffer(word, dtype=np.uint8)
        places = [0, *(np.flatnonzero(~self.beside[data[:-1], data[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def _encode(self, raw: list[bytes], statement: str) -> list[tuple[str, str]]:
        lengths = np.array([len(w) for w in raw])
        data, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(lengths)
        place = np.arange(len(data), dtype=np.int32)
        following, before = place + 1, place - 1
        following[ends - 1] = -1
        before[ends - lengths] = -1
        self._table("start", {"w": np.repeat(np.arange(len(raw), dtype=np.int32), lengths), "p": place, "n": following, "q": before, "t": self.byte[data]})
        self.db.execute(statement)
        found = self.db.sql(DECODE).to_arrow_table()
        return list(zip(found.column("ids").to_pylist(), found.column("back").to_pylist(), strict=True))


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def _kept(path: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Words that this worker has encoded, and what their ids decode to; encode() bounds them."""
    return {}, {}


def _portions(words: set[str]) -> Iterator[list[str]]:
    portion, size = [], 0
    for word in words:
        portion.append(word)
        size += 4 * len(word) if len(word) > LONG else len(word)
        if len(portion) >= WORDS or size >= WORD_BYTES:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def encode(docs: DataFrame, ranks_path: str = vocab.RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded bytes).

    One row for each row of docs, whatever repeats; a null or empty text has no ids, and both sums
    are those of nothing. Texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(vocab.PATTERN).findall
        ids, back = _kept(ranks_path)
        for batch in batches:
            for part in rows_of(batch, PORTION):
                split = [find(t.decode("utf-8", "replace")) for t in part.column("text").to_pylist()]
                words = set().union(*split)
                if len(ids) > KEPT:
                    for kept in (ids, back):
                        for word in kept.keys() - words:
                            del kept[word]
                for portion in _portions(words - ids.keys()):
                    encoded, decoded = codec(ranks_path).words(portion)
                    ids.update(zip(portion, map(str.encode, encoded), strict=True))
                    back.update(zip(portion, (b.encode("latin-1") for b in decoded), strict=True))
                sums: tuple[list, list, list] = [], [], []
                for found in split:
                    text = b" ".join(map(ids.__getitem__, found))
                    sums[0].append(text.count(b" ") + 1 if text else 0)
                    sums[1].append(hashlib.sha256(text).hexdigest())
                    sums[2].append(hashlib.sha256(b"".join(map(back.__getitem__, found))).hexdigest())
                for word in [w for w in words if len(w) > KEEP]:
                    del ids[word], back[word]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.string()), pa.array(sums[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
