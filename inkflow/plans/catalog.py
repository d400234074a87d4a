"""The registered queries and their DuckDB forms.

The driver's tables hold no pictures, so each query derives names, bytes or sizes from a table's
columns and applies an operator to them; its SQL form derives and computes the same by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow.config import CHARSET_NAMES, CHARSETS, DCT_METHODS, KERNELS
from inkflow.functions import magic, names, options, resizing
from inkflow.operators import convert, ranking, registry, resample
from inkflow.sources import archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql_choose(key: str, values: list[str]) -> str:
    return f"({_sql_list(values)})[(({key}) % {len(values)} + 1)::int]"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ENDINGS = [".jpg", ".JPG", ".jpeg", ".PNG", ".tar.png", ".bmp", ".txt", ""]
FOLDERS = ["", ".git/", "x/.git/", ".github/"]
_PATH = f"lang || '/' || source || '/' || doc_id || {_sql_choose('doc_id', ENDINGS)}"
_EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
_PICTURE = f"list_contains({_sql_list(list(names.EXTENSIONS))}, ext)"
_RENAMED = "(case when ends_with(path, ext) then left(path, length(path) - length(ext)) else path end) || '.jpg'"
_ENTRIES = f"entries as (select doc_id, path, {_EXT} as ext from (select doc_id, {_PATH} as path from documents))"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), _choose(F.col("doc_id"), ENDINGS)))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("ext", names.extension(F.col("path")))


@_query("ext_filter", f"with {_ENTRIES} select * from entries where {_PICTURE}")
def ext_filter(spark, sf_dir):
    return _entries(spark, sf_dir).filter(names.is_picture(F.col("path")))


@_query("prune_git", f"select * from (select doc_id, {_sql_choose('doc_id', FOLDERS)} || doc_id || '.png' as path from documents) where not starts_with(path, '.git/')")
def prune_git(spark, sf_dir):
    path = F.concat(_choose(F.col("doc_id"), FOLDERS), F.col("doc_id").cast("string"), F.lit(".png"))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).filter(names.outside_git(F.col("path")))


@_query("walk_order", "select page_id, row_number() over (partition by host order by string_split(path, '/'), page_id) as place from (select page_id, regexp_extract(url, '//([^/]*)', 1) as host, regexp_extract(url, '//(.*)$', 1) as path from pages)")
def walk_order(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("archive"), F.regexp_extract("url", r"//(.*)\z", 1).alias("path"))
    return ranking.ranked(pages, "archive", [names.walk_key(F.col("path")), F.col("page_id")]).select("page_id", "place")


@_query("rename_ext", f"with {_ENTRIES} select doc_id, {_RENAMED} as out_path from entries where {_PICTURE}")
def rename_ext(spark, sf_dir):
    return ext_filter(spark, sf_dir).select("doc_id", names.renamed(F.col("path"), F.col("ext")).alias("out_path"))


_COLLIDING = "(select 'd' || (doc_id // 2) || (['.png', '.jpg', '.JPG'])[(doc_id % 3 + 1)::int] as path, doc_id from documents)"


@_query("name_collision", f"select doc_id, out_path, count(*) over (partition by out_path) > 1 as name_collision from (select doc_id, {_RENAMED} as out_path from (select *, {_EXT} as ext from {_COLLIDING}))")
def name_collision(spark, sf_dir):
    path = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"), _choose(F.col("doc_id"), [".png", ".jpg", ".JPG"]))
    docs = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("ext", names.extension(F.col("path")))
    out = docs.select("doc_id", F.lit("x.zip").alias("archive"), names.renamed(F.col("path"), F.col("ext")).alias("out_path"))
    return convert.flagged(out).drop("archive")


HEADS = ["FFD8", "89504E470D0A1A0A", "424D0102030400000000", "52494646010203045745425056503820", "00112233", "52494646", "42", "FF"]
_CONTENT = f"{_sql_choose('doc_id', HEADS)} || (case when doc_id % 5 = 0 then '' else hex(encode(text)) end)"


def _hex_matches(pattern: bytes) -> str:
    pairs = "".join(".." if b == ord("?") else f"{b:02X}" for b in pattern)
    return f"regexp_matches(h, '^{pairs}')"


_ENGINE = "case " + " ".join(f"when {_hex_matches(p)} then '{n}'" for n, p in registry.default().patterns().items()) + " end"


@_query("sniff_magic", f"select doc_id, {_ENGINE} as engine from (select doc_id, {_CONTENT} as h from documents)")
def sniff_magic(spark, sf_dir):
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(b"")).otherwise(F.encode("text", "utf-8"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(_choose(F.col("doc_id"), HEADS)), body).alias("content"))
    return docs.select("doc_id", magic.engine(F.col("content"), registry.default().patterns()).alias("engine"))


@_query("wildcard_magic", f"select p_partkey, {_hex_matches(magic.WEBP)} as is_webp from (select p_partkey, left('52494646' || upper(printf('%08x', p_partkey)) || '574542505650382058', (24 + p_partkey % 12)::int) as h from part)")
def wildcard_magic(spark, sf_dir):
    digits = F.concat(F.lit("52494646"), F.lpad(F.hex("p_partkey"), 8, "0"), F.lit("574542505650382058"))
    content = F.unhex(F.substring(digits, F.lit(1), (24 + F.col("p_partkey") % 12 - F.col("p_partkey") % 2).cast("int")))
    return _table(spark, sf_dir, "part").select("p_partkey", magic.matches(content, magic.WEBP).alias("is_webp"))


@_query("png_dims", "select p_partkey, (p_size * 37 + 1)::int as width, (p_partkey % 65536)::int as height from part")
def png_dims(spark, sf_dir):
    word = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    content = F.concat(F.lit(magic.PNG), F.unhex(F.lit("0000000D49484452")), word((F.col("p_size") * 37 + 1).cast("long")), word(F.col("p_partkey") % 65536))
    return _table(spark, sf_dir, "part").select("p_partkey", magic.png_size(content).alias("size")).select("p_partkey", "size.*")


@_query("bmp_dims", "select s_suppkey, (s_suppkey * 7 + 1)::int as width, (s_suppkey % 1000 + 1)::int as height from supplier")
def bmp_dims(spark, sf_dir):
    word = lambda x: F.reverse(F.array(*[F.lpad(F.hex((x / 256**i).cast("long") % 256), 2, "0") for i in (3, 2, 1, 0)]))
    height = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 1000 + 1).otherwise(2**32 - F.col("s_suppkey") % 1000 - 1)
    digits = F.concat(F.array(F.lit("424D00000000000000003600000028000000")), word(F.col("s_suppkey") * 7 + 1), word(height))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", magic.bmp_size(F.unhex(F.array_join(digits, ""))).alias("size")).select("s_suppkey", "size.*")


_SIZES = "(select o_orderkey, (o_orderkey * 37 % 3000 + 1)::bigint as w, (o_custkey * 91 % 2500 + 1)::bigint as h from orders)"


def _plan_sql(ratio: int) -> str:
    if ratio == 100:
        return f"select o_orderkey, w as target_w, h as target_h, false as do_resize, false as warn_small from {_SIZES}"
    factor = "(1280::double / w)" if ratio == 70 else f"({ratio}::double / 100)"
    small = "w <= 1280" if ratio == 70 else "false"
    size = lambda x: f"(case when {small} then {x} else round({x}::double * {factor})::bigint end)"
    return f"select o_orderkey, target_w, target_h, not small and not warn as do_resize, warn as warn_small from (select *, target_w <= 500 or target_h <= 100 as warn from (select o_orderkey, {size('w')} as target_w, {size('h')} as target_h, {small} as small from {_SIZES}))"


def _plan_query(ratio: int) -> Query:
    def run(spark, sf_dir):
        orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 3000 + 1).alias("w"), (F.col("o_custkey") * 91 % 2500 + 1).alias("h"))
        return orders.select("o_orderkey", *[c.alias(n) for n, c in resizing.plan(F.col("w"), F.col("h"), ratio).items()])

    return run


for _name, _ratio in (("resize_plan_default", 70), ("resize_plan_ratio50", 50), ("resize_plan_ratio100", 100)):
    _query(_name, _plan_sql(_ratio))(_plan_query(_ratio))


@_query("clamp_pct", "select l_orderkey, l_linenumber, coalesce(case when n >= 100 then 100 when n <= 0 then 70 else n end, -1)::int as ratio from (select l_orderkey, l_linenumber, case when regexp_full_match(t, '[+-]?[0-9]+') then try_cast(t as bigint) end as n from (select *, (['', '+', ' ', '-', 'x'])[(l_orderkey % 5 + 1)::int] || (l_partkey % 130) as t from lineitem))")
def clamp_pct(spark, sf_dir):
    text = F.concat(_choose(F.col("l_orderkey"), ["", "+", " ", "-", "x"]), (F.col("l_partkey") % 130).cast("string"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(options.percent(text, 70), F.lit(-1)).alias("ratio"))


CHARSET_TEXTS = ["ja,zh", "JA,ja", "ja,ja-jp", "ja, zh", "ko,zh-cn,KO-KR", "xx,yy", ""]
_CHARSETS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in CHARSETS.items()) + "}"
_CHARSET_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in CHARSET_NAMES.items()) + "}"
# The first occurrence of each token stays.
_DISTINCT = lambda x: f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda p: list_position({x}, p[1]) = p[2]), lambda p: p[1])"


@_query("charset_parse", f"select c_custkey, array_to_string(e, '|') as encodings, case when e is not null then array_to_string({_DISTINCT('s')}, ',') end as names from (select *, list_transform(e, lambda x: {_CHARSET_NAMES}[x]) as s from (select c_custkey, case when len(list_filter(f, lambda x: x is null)) = 0 then f end as e from (select c_custkey, list_transform({_DISTINCT('t')}, lambda x: {_CHARSETS}[x]) as f from (select c_custkey, string_split(lower({_sql_choose('c_custkey', CHARSET_TEXTS)}), ',') as t from customer))))")
def charset_parse(spark, sf_dir):
    found = _table(spark, sf_dir, "customer").select("c_custkey", options.charsets(_choose(F.col("c_custkey"), CHARSET_TEXTS)).alias("e"))
    return found.select("c_custkey", F.when(F.col("e").isNotNull(), F.array_join("e", "|")).alias("encodings"), F.when(F.col("e").isNotNull(), options.charset_names(F.col("e"))).alias("names"))


_OPTION_TEXTS = [*DCT_METHODS, *KERNELS, "fast", "Lanczos3", ""]


@_query("enum_parse", f"select n_nationkey, word, case when list_contains({_sql_list(list(DCT_METHODS))}, word) then word end as dct, case when list_contains({_sql_list(list(KERNELS))}, word) then word end as kernel from nation, (select unnest({_sql_list(_OPTION_TEXTS)}) as word)")
def enum_parse(spark, sf_dir):
    words = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _OPTION_TEXTS))).alias("word"))
    return words.select("n_nationkey", "word", options.dct_method(F.col("word")).alias("dct"), options.kernel(F.col("word")).alias("kernel"))


OUTPUTS = ["/d/x.zip", "/d/x.rar", "/d/x", "/d/x.ZIP", "/d.e/x", "x.tar.gz"]


@_query("out_name", f"select s_suppkey, (case when ends_with(p, '.zip') then p else p || '.zip' end) as output from (select s_suppkey, regexp_replace({_sql_choose('s_suppkey', OUTPUTS)}, '^((?:.*/)?[^/]*?)(\\.[^./]*)?$', '\\1_resize\\2') as p from supplier)")
def out_name(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", names.default_output(_choose(F.col("s_suppkey"), OUTPUTS)).alias("output"))


@_query("info_text", "select p_partkey, printf('{engine:%s, w:%d, h:%d}', ltrim(lower((['.JPG', 'png', '..bmp'])[(p_partkey % 3 + 1)::int]), '.'), p_size, p_partkey) as info from part")
def info_text(spark, sf_dir):
    engine = names.plugin_name(_choose(F.col("p_partkey"), [".JPG", "png", "..bmp"]))
    return _table(spark, sf_dir, "part").select("p_partkey", names.info(engine, F.col("p_size"), F.col("p_partkey")).alias("info"))


@_query("error_text", "select s_suppkey, 'Identify: ' || s_name || ' error, unknown image' as message from supplier")
def error_text(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", names.failure(F.lit("Identify"), F.col("s_name"), F.lit("unknown image")).alias("message"))


_ENGINES = {"click": "png", "purchase": "jpeg", "view": "bmp"}


@_query("decoder_lookup", "select event_id, event_type, engine, engine is not null as known from events left join (values ('click', 'png'), ('purchase', 'jpeg'), ('view', 'bmp')) d(kind, engine) on kind = event_type")
def decoder_lookup(spark, sf_dir):
    engine = F.try_element_at(F.create_map(*[F.lit(x) for pair in _ENGINES.items() for x in pair]), F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", "event_type", engine.alias("engine")).withColumn("known", registry.default().supports(F.col("engine")))


@_query("last_write_wins", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def last_write_wins(spark, sf_dir):
    return archives.last_written(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@_query("size_check", "select doc_id, n_chars, length(text) = n_chars as intact from documents")
def size_check(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars", archives.intact(F.char_length("text"), F.col("n_chars")).alias("intact"))


#: Members of a row of entry_list; small, so that the tables' archives have several rows.
LIST_ROWS = 40


@_query(
    "entry_list",
    f"""with {_ENTRIES}, placed as (
        select split_part(path, '/', 1) as archive, path, row_number() over (partition by split_part(path, '/', 1) order by string_split(path, '/')) - 1 as place from entries where {_PICTURE}
    ) select archive, place // {LIST_ROWS} as chunk, count(*) as n, array_to_string(list(path order by place), '|') as members from placed group by 1, 2""",
)
def entry_list(spark, sf_dir):
    entries = ext_filter(spark, sf_dir).select(F.substring_index("path", "/", 1).alias("archive"), "path")
    return ranking.member_lists(entries, LIST_ROWS).withColumn("members", F.array_join("members", "|"))


def _line_sql(kernel: str) -> str:
    rows = resample.weights(64, 20, kernel)
    sums = ", ".join(" + ".join(f"embedding[{at + 1}]::double * {w!r}::double" for at, w in row) for row in rows)
    return f"select vec_id, unnest(range(20))::int as place, floor(unnest([{sums}]) * 1000000 + 0.5) / 1000000 as sample from embeddings"


def _line_query(kernel: str) -> Query:
    def run(spark, sf_dir):
        line = resample.resampled_line(F.col("embedding"), 64, 20, kernel)
        return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(line).alias("place", "sample")).withColumn("sample", F.floor(F.col("sample") * 1000000 + 0.5) / 1000000)

    return run


for _kernel in KERNELS:
    _name = f"resample_1d_{_kernel.replace('-', '_')}"
    _query(_name, _line_sql(_kernel))(_line_query(_kernel))


@_query("ext_union", f"select r_regionkey, unnest({_sql_list(registry.default().extensions())}) as ext from region")
def ext_union(spark, sf_dir):
    return _table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, registry.default().extensions()))).alias("ext"))


_MANIFEST_SIZE = "(doc_id * 37 % 3000 + 1)::bigint as w, (n_chars * 91 % 2500 + 1)::bigint as h"


@_query(
    "convert_manifest",
    f"""with {_ENTRIES}, e as (
        select e.doc_id, e.path, e.ext, {_CONTENT} as h_, {_MANIFEST_SIZE} from entries e join documents d using (doc_id) where {_PICTURE}
    ), s as (select *, {_ENGINE.replace("(h, ", "(h_, ")} as engine from e),
    t as (select *, w <= 1280 as small, (case when w <= 1280 then w else round(w::double * (1280::double / w))::bigint end) as target_w, (case when w <= 1280 then h else round(h::double * (1280::double / w))::bigint end) as target_h from s where engine is not null)
    select doc_id, path, engine, w::int as width, h::int as height, target_w, target_h, not small and not (target_w <= 500 or target_h <= 100) as do_resize, target_w <= 500 or target_h <= 100 as warn_small,
        {_RENAMED} as out_path, row_number() over (partition by split_part(path, '/', 1) order by string_split(path, '/')) as place from t""",
)
def convert_manifest(spark, sf_dir):
    """Filter by ending, recognise by content, plan the size, rename, order: a conversion without pixels."""
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(b"")).otherwise(F.encode("text", "utf-8"))
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), _choose(F.col("doc_id"), ENDINGS)))
    docs = _table(spark, sf_dir, "documents").withColumn("path", path).filter(names.is_picture(F.col("path")))
    content = F.concat(F.unhex(_choose(F.col("doc_id"), HEADS)), body)
    found = docs.select("doc_id", "path", names.extension(F.col("path")).alias("ext"), magic.engine(content, registry.default().patterns()).alias("engine"), (F.col("doc_id") * 37 % 3000 + 1).cast("int").alias("width"), (F.col("n_chars") * 91 % 2500 + 1).cast("int").alias("height")).filter("engine is not null")
    planned = found.withColumns(resizing.plan(F.col("width"), F.col("height"), 70))
    rows = planned.select("doc_id", "path", "engine", "width", "height", "target_w", "target_h", "do_resize", "warn_small", names.renamed(F.col("path"), F.col("ext")).alias("out_path"), F.substring_index("path", "/", 1).alias("archive"))
    return ranking.ranked(rows, "archive", [names.walk_key(F.col("path"))]).drop("archive")
