"""Fill-in-middle transformation by lookaround splitting, with DataFrame functions only.

A grammar of units says which characters may stand on both sides of a place where one unit ends and
the next begins. Each such pair of classes becomes a zero-width pattern, (?<=before)(?=after), so that Spark's
split takes nothing away: joined again, the pieces are the text. Splitting an empty text gives one empty piece, which is no
unit; it is counted apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.llm.common import table

SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Unit grammars: the pairs of neighbouring character classes that a boundary lies between.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "token": ((OTHER, SPACE),),  # a word with the white space before it; white space at the end is a unit
    "run": ((OTHER, SPACE), (SPACE, OTHER)),  # words and runs of white space
    "line": ((r"\n", r"[\x{0}-\x{10FFFF}]"),),  # each with its line break
    "character": ((r"[\x{0}-\x{10FFFF}]", r"[\x{0}-\x{10FFFF}]"),),  # code points
}


class Sentinels(NamedTuple):
    """The marks before each part; none of them may be part of another, or hold its own first character twice."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def boundary(grammar: Sequence[tuple[str, str]]) -> str:
    """The zero-width pattern of a grammar; it never lies between the halves of a surrogate pair."""
    return "(?![\\x{DC00}-\\x{DFFF}])(?:" + "|".join(f"(?<={before})(?={after})" for before, after in grammar) + ")"


def units(text: Column, unit: str = "token") -> Column:
    """The units of a text, in order; an empty text has none, a null one is null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[unit]), -1))


def _draw(key: Column, at: int) -> Column:
    """The at-th group of 8 hexadecimal digits of key, from 1, as a number."""
    return F.conv(F.substring(key, 8 * at - 7, 8), 16, 10).cast("long")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):X}}}" for c in text)


def infilled(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", marks: Sentinels = Sentinels()) -> DataFrame:  # noqa: B008  immutable
    """doc_id, n, form, prefix, middle, suffix, output for each row of docs.

    The first four groups of 8 digits of sha256("<seed>:<doc_id>") decide: two cuts among the n + 1 places between units, whether
    the text is rearranged (rate per cent are), and whether suffix comes before prefix (spm per cent of these). form is
    psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the text itself, also where it is empty or holds a mark;
    prefix, middle and suffix are null then. A null text is empty; a null doc_id is hashed as no
    digits; rows that repeat give equal rows. A text is one array of its units in memory. No shuffle, and no rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"), units(text, unit).alias("units")).withColumn("n", F.size("units").cast("long"))
    first, second = (_draw(F.col("key"), i) % (F.col("n") + 1) for i in (1, 2))
    plain = (F.col("text") == "") | F.contains("text", F.lit(marks.prefix)) | F.contains("text", F.lit(marks.suffix)) | F.contains("text", F.lit(marks.middle)) | (_draw(F.col("key"), 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("key"), 4) % 100 < spm, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", "n", "units", form.alias("form"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    joined = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = cut.select(
        "doc_id", "text", "n", "form",
        joined(F.lit(1), F.col("a")).alias("prefix"), joined(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), joined(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
    )
    before, after, last = (F.concat(F.lit(m), F.col(c)) for m, c in zip(marks, ("prefix", "suffix", "middle"), strict=True))
    output = F.when(F.col("form") == "psm", F.concat(before, after, last)).when(F.col("form") == "spm", F.concat(after, before, last)).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:  # noqa: B008  immutable
    """The text that an output and its form stand for."""
    pieces = F.split(output, "|".join(map(_quoted, marks)), -1)  # a text that holds a mark is plain, so the marks found are those that were set
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3), F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda i: F.get(pieces, i)), ""))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilled(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
    with t as (
        select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as k,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
        from documents
    ), h as (
        select *, len(u) as n, ('0x' || k[1:8])::bigint as h1, ('0x' || k[9:16])::bigint as h2, ('0x' || k[17:24])::bigint as h3, ('0x' || k[25:32])::bigint as h4 from t
    ), c as (
        select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
        from h
    ), p as (
        select *, coalesce(array_to_string(u[1:a], ''), '') as prefix, coalesce(array_to_string(u[a + 1:b], ''), '') as middle, coalesce(array_to_string(u[b + 1:n], ''), '') as suffix from c
    )
    select doc_id, n::bigint as n, form,
        case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
    from p
"""
