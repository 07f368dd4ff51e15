"""The registered queries outside the training-data subpackage, and the SQL that states their results.

Ring R restates behaviour of the analysis; ring X extends it to lookup. The
tables hold no JavaScript, so scripts are built from columns: what a parser
must find in them is then known without parsing, and SQL can state it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.functions import eligibility as el
from thresher.functions import normalize as nz
from thresher.operators import fragments as op
from thresher.operators import similarity as sim
from thresher.operators.nearindex import NearIndex
from thresher.operators.vectorindex import VectorIndex
from thresher.operators.weighted import DIMENSION, WeightedEmbedding, bins_in_batches
from thresher.plans import pipeline as pl
from thresher.scratch import place, stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the normal form -------------------------------------------------------


def sql_step(step: str, x: str) -> str:
    return {
        "line": f"regexp_replace({x}, '{nz.LINE_COMMENT}', ' ', 'g')",
        "block": f"regexp_replace({x}, '{nz.BLOCK_COMMENT}', ' ', 'g')",
        "semicolon": f"replace({x}, ';', '')",
        "space": f"regexp_replace({x}, '{nz.WHITE_SPACE}', '', 'g')",
    }[step]


def sql_normal(x: str) -> str:
    for step in ("line", "block", "semicolon", "space"):
        x = sql_step(step, x)
    return x


#: Something for every rule to act on, since the tables hold prose and pages.
_SEASONED = ("url: \"http://a.b/", "\"; // one\n/* two\n three */ for (;;) { x\t= 1; }\r\n/* // four */ tail")


def _seasoned(text: Column) -> Column:
    return F.concat(F.lit(_SEASONED[0]), text, F.lit(_SEASONED[1]))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\r", "' || chr(13) || '") + "'"


def _sql_seasoned(x: str) -> str:
    return f"({_sql_text(_SEASONED[0])} || {x} || {_sql_text(_SEASONED[1])})"


def _normalize(name: str, keys: list[str], text: str) -> tuple[Query, str]:
    def run(spark, sf_dir):
        return table(spark, sf_dir, name).select(*keys, nz.normalize_js(F.col(text)).alias("processed"), nz.normalize_js(_seasoned(F.col(text))).alias("processed_seasoned"))

    return run, f"SELECT {', '.join(keys)}, {sql_normal(text)} AS processed, {sql_normal(_sql_seasoned(text))} AS processed_seasoned FROM {name}"


def _step(step: str, form: Callable[[Column], Column]) -> tuple[Query, str]:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pages").select("page_id", form(_seasoned(F.col("html"))).alias("processed"))

    return run, f"SELECT page_id, {sql_step(step, _sql_seasoned('html'))} AS processed FROM pages"


def unify_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\rlast\n"))
    return table(spark, sf_dir, "documents").select("doc_id", nz.unify_newlines(mixed).alias("text"))


# --- eligibility -----------------------------------------------------------

def _path() -> Column:
    ending = F.when(F.col("doc_id") % 3 == 0, ".test.js").when(F.col("doc_id") % 3 == 1, ".js").otherwise(".spec.js")
    return F.concat(F.lit("src/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), ending)


_SQL_PATH = "('src/' || source || '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.test.js' WHEN 1 THEN '.js' ELSE '.spec.js' END)"


def _spiced(marker: str) -> Column:
    """The text with a marker at its start, at the very end of the sample that rules see, there with a line end, or not at all, by the id."""
    c, n, room = F.col("text"), F.col("doc_id") % 4, el.SAMPLE_CHARS - len(marker)
    end = F.concat(F.substring(c, 1, room), F.lit(marker))
    line = F.concat(F.substring(c, 1, room - 1), F.lit(marker + "\n"))
    return F.when(n == 0, F.concat(F.lit(marker), c)).when(n == 1, end).when(n == 2, line).otherwise(c)


def _sql_spiced(marker: str) -> str:
    m, line, room = _sql_text(marker), _sql_text(marker + "\n"), el.SAMPLE_CHARS - len(marker)
    return f"(CASE doc_id % 4 WHEN 0 THEN {m} || text WHEN 1 THEN left(text, {room}) || {m} WHEN 2 THEN left(text, {room - 1}) || {line} ELSE text END)"


_SAMPLE = "left({}, 5000)"


def _sql_longest(x: str) -> str:
    return f"coalesce(list_max(list_transform((regexp_split_to_array({x}, '{el.LINE_BREAK}'))[1:{el.MAX_LINES}], lambda l: length(l))), 0)"


def _sql_hits(x: str) -> dict[str, str]:
    return {
        "source_map": f"contains({x}, '{el.SOURCE_MAP}')",
        "min_suffix": f"regexp_matches({x}, '{el.MINIFIED_END}')",
        "dense": f"(length({x}) >= 500 AND NOT regexp_matches({x}, '[\\\\n]'))",
        "bracket_run": f"regexp_matches({x}, '{el.BRACKET_RUN}')",
        "brace_run": f"regexp_matches({x}, '{el.BRACE_RUN}')",
    }


def _marked(marker: str, hit: Callable[[Column], Column], kind: str) -> tuple[Query, str]:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", hit(el.sample_of(_spiced(marker))).alias("hit"))

    return run, f"SELECT doc_id, {_sql_hits(_SAMPLE.format(_sql_spiced(marker)))[kind]} AS hit FROM documents"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = F.translate("text", "n", "m")
    return table(spark, sf_dir, "documents").select("doc_id", el.is_dense(el.sample_of(F.col("text"))).alias("hit"), el.is_dense(el.sample_of(few)).alias("hit_without_n"))


_DENSE_SQL = f"SELECT doc_id, {_sql_hits(_SAMPLE.format('text'))['dense']} AS hit, {_sql_hits(_SAMPLE.format('''replace(text, 'n', 'm')'''))['dense']} AS hit_without_n FROM documents"


def max_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = el.longest_line(el.sample_of(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", long.alias("longest"), (long <= el.MAX_LINE_LENGTH).alias("passes"))


def exclude_test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _path().alias("path")).where(el.not_a_test(F.col("path")))


def exclude_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _path().alias("path")).where(el.outside_folders(F.col("path"), ["src0", "src7"]))


def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("bytes"), el.small_enough(size).alias("small"), el.small_enough(size * 100).alias("small_times_100"))


def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), "text")
    return rows.where(el.eligible(F.col("path"), F.col("text"), F.octet_length("text"))).select("doc_id", "path")


def _marks() -> Column:
    """By the id, something at the head of the text for a rule to act on, or nothing."""
    n, out = F.col("doc_id") % 8, F.lit("")
    for k, mark in enumerate(_MARKS):
        out = F.when(n == k, mark).otherwise(out)
    return out


_MARKS = ("[[[1]]]\n", "{{{1}}}\n", "//# sourceMappingURL=x\n", "x" * 501 + "\n")


def turned_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each document would not be analysed, null where it would."""
    text = F.concat(_marks(), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), text.alias("text"))
    return rows.select("doc_id", el.turned_away(F.col("path"), F.col("text"), F.octet_length("text") * 10, ("src0", "src7")).alias("reason"))


_X = _SAMPLE.format("text")
_TURNED_SQL = f"""
SELECT doc_id, CASE WHEN ends_with(path, '.test.js') THEN 'test' WHEN list_has_any(string_split(path, '/'), ['src0', 'src7']) THEN 'folder'
    WHEN {_sql_hits(_X)['source_map']} THEN 'source map' WHEN {_sql_hits(_X)['min_suffix']} THEN 'minified end' WHEN {_sql_hits(_X)['dense']} THEN 'dense'
    WHEN {_sql_hits(_X)['bracket_run']} THEN 'brackets' WHEN {_sql_hits(_X)['brace_run']} THEN 'braces'
    WHEN {_sql_longest(_X)} > 500 THEN 'long line' WHEN strlen(text) * 10 > 1000000 THEN 'too large' END AS reason
FROM (SELECT doc_id, {_SQL_PATH} AS path, (CASE doc_id % 8 {' '.join(f'WHEN {k} THEN {_sql_text(m)}' for k, m in enumerate(_MARKS))} ELSE '' END) || text AS text FROM documents)
"""
_ELIGIBLE_SQL = f"""
SELECT doc_id, path FROM (SELECT *, {_SQL_PATH} AS path FROM documents)
WHERE NOT ends_with(path, '.test.js') AND strlen(text) <= 1000000
  AND NOT ({' OR '.join(_sql_hits(_X).values())}) AND {_sql_longest(_X)} <= 500
"""


def changed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing split into paths, without the empty one after the last line end."""
    listing = F.concat(F.col("n_name"), F.lit(".js\nlib/"), F.col("n_name"), F.lit(".js\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.split(listing, "\n")).alias("path")).where("path <> ''")


# --- lines, batches, workers ----------------------------------------------


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", nz.line_of(F.col("text"), half).alias("line"), nz.line_of(F.col("text"), F.length("text")).alias("last_line"))


def batches_of_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return pl.batch_numbers(rows, "doc_id").groupBy("batch").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def batches_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by the order of paths, with the bytes before each."""
    rows = table(spark, sf_dir, "documents").select(_path().alias("path"), F.octet_length("text").cast("long").alias("length"))
    placed = pl.numbered(rows, "path", "length").withColumn("batch", F.floor(F.col("number") / pl.BATCH_SIZE))
    return placed.groupBy("batch").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.min("before").alias("bytes_before"))


def worker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"))
    return rows.select("source", pl.worker_count(F.lit(64), F.col("files")).alias("workers"))


# --- scripts with known functions -----------------------------------------


class Script:
    """A script as a template whose «column» marks stand for columns, and the functions in it."""

    def __init__(self, rows: str, key: str, text: str, functions: list[str]):
        self.rows, self.key, self.text, self.functions = rows, key, text, functions
        self.path = f"app/{rows}_«{key}».js"

    @staticmethod
    def _parts(template: str) -> list[tuple[bool, str]]:
        return [(k % 2 == 1, p) for k, p in enumerate(re.split("[«»]", template)) if p]

    def column(self, template: str) -> Column:
        return F.concat(*[F.col(p).cast("string") if is_column else F.lit(p) for is_column, p in self._parts(template)])

    def sql(self, template: str) -> str:
        return "(" + " || ".join(f"CAST({p} AS VARCHAR)" if is_column else _sql_text(p) for is_column, p in self._parts(template)) + ")"

    def files(self, spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
        """The scripts of a table; its rows are dealt to tasks before scripts are made of them, if asked for."""
        rows = table(spark, sf_dir, self.rows).select(*sorted({p for t in (self.path, self.text) for is_column, p in self._parts(t) if is_column}))
        return (pl.spread(rows) if dealt else rows).select(self.column(self.path).alias("path"), self.column(self.text).alias("text"))

    def lines(self, function: str) -> tuple[int, int]:
        at = self.text.index(function)
        return self.text.count("\n", 0, at) + 1, self.text.count("\n", 0, at + len(function)) + 1

    def query(self) -> tuple[Query, str]:
        def run(spark, sf_dir):
            return op.fragments(self.files(spark, sf_dir, dealt=True))

        return run, self.rows_sql()

    def rows_sql(self) -> str:
        selects = []
        for f in self.functions:
            start, end = self.lines(f)
            selects.append(f'SELECT {self.sql(f)} AS code, CAST({start} AS INTEGER) AS start, CAST({end} AS INTEGER) AS "end", {sql_normal(self.sql(f))} AS "processedCode", {self.sql(self.path)} AS path FROM {self.rows}')
        if not selects:
            return f'SELECT \'\' AS code, CAST(0 AS INTEGER) AS start, CAST(0 AS INTEGER) AS "end", \'\' AS "processedCode", \'\' AS path FROM {self.rows} WHERE false'
        return "\nUNION ALL ".join(selects)


_INIT = 'onInit() {\n\t\t\tthis.name = "«n_name»"; // the name\n\t\t\tthis.url = "http://x/«n_nationkey»";\n\t\t}'
_LATER = "async _load(a, b = {c: 1}) {\n\t\t\treturn a / b /* ratio */;\n\t\t}"
METHODS = Script("nation", "n_nationkey", f'sap.ui.define(["a"], (B) => {{\n\treturn B.extend("x.«n_name»", {{\n\t\t{_INIT},\n\n\t\t{_LATER},\n\t}});\n}});\n', [_INIT, _LATER])

_ARROWS = ['(x) => {\n  return "«p_brand»" + x;\n}', "async y => y * «p_size»", "() => ({ z: [1, «p_partkey»] })"]
ARROWS = Script("part", "p_partkey", "const o = {\n  first: " + _ARROWS[0] + ",\n  second: " + _ARROWS[1] + " /* after */,\n  third: " + _ARROWS[2] + "\n};\n", _ARROWS)

_VALUES = ["function () { return /[}/]{2}/.test('«n_name»'); }", "async function named(a) {\n  return `${a}-${{k: «n_nationkey»}.k}`;\n}"]
FUNCTION_VALUES = Script("nation", "n_nationkey", "var o = {a: " + _VALUES[0] + ", b: " + _VALUES[1] + ",\n  c: function* () { yield 1; }, d: (function () {}), e: function () {}.bind(this)};\n", _VALUES)

_DEEP = "done() {\n      return «n_nationkey»;\n    }"
_OUTER = "load() {\n    call({\n    " + _DEEP + ",\n    fail: 1});\n  }"
NESTED = Script("nation", "n_nationkey", "A.extend('n', {\n  " + _OUTER + "\n});\n", [_OUTER, _DEEP])

_CLASS = ["constructor(n) { super(n); this.n = «n_nationkey»; }", "static make() { return new this(«n_regionkey»); }", "get name() {\n    return '«n_name»';\n  }", "*items() { yield* []; }"]
CLASSES = Script("nation", "n_nationkey", "export class C extends D {\n  #p() { return 1; }\n  field = () => 2\n  " + "\n  ".join(_CLASS) + "\n  'quoted'() {}\n}\n", _CLASS)

_FREE = ["a() { return «o_orderkey»; }", "() => '«o_orderstatus»'"]
NO_SCOPE = Script("orders", "o_orderkey", "x.extend({ " + _FREE[0] + " });\ny = { b: " + _FREE[1] + " };\n", _FREE)

IGNORED = Script(
    "nation",
    "n_nationkey",
    "function top() { return «n_nationkey»; }\nconst f = () => '«n_name»';\nrun(function () {}, () => 1);\nvar o = { f, g: top, 's'() {}, 7() {}, [f]() {}, h: (() => 2), i: f || (() => 3) };\nconst { k: l = () => 4 } = o;\n",
    [],
)
_ONLY = "only() { return '«r_name»'; }"
SEVERAL = Script("region", "r_regionkey", "before = { no() {} };\nA.extend('a', { " + _ONLY + " });\nB.extend('b', { alsoNo() {} });\n", [_ONLY])

_MARKUP = ["show() {\n    return <li key={«r_regionkey»} title='«r_name»'>it's {this.name} &amp; } more</li>;\n  }", "x => <B on={{ click() { return '«r_name»'; } }} />", "click() { return '«r_name»'; }", "plain() {}"]
MARKUP = Script("region", "r_regionkey", "const o = {\n  " + _MARKUP[0] + ",\n  item: " + _MARKUP[1] + ",\n  " + _MARKUP[3] + "\n};\n", _MARKUP)

_BAD = ["a() { return «n_nationkey»; }", "b() {\n    y = (1, [2;\n  }", "c() { return 'no end\n  }"]
BROKEN = Script("nation", "n_nationkey", "x = )\nA.extend('«n_name»', {\n  " + ",\n  ".join(_BAD) + "\n});\nz = ]\nq = {", _BAD)

SCRIPTS = {
    "fragments_methods": METHODS,
    "fragments_arrows": ARROWS,
    "fragments_function_values": FUNCTION_VALUES,
    "fragments_nested": NESTED,
    "fragments_classes": CLASSES,
    "fragments_no_scope": NO_SCOPE,
    "fragments_ignored_forms": IGNORED,
    "fragments_first_scope": SEVERAL,
    "fragments_markup": MARKUP,
    "fragments_broken_text": BROKEN,
}

_BROKEN = "{ a() {"


def chunks_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for every file: with functions, without any, and one that breaks off."""
    files = METHODS.files(spark, sf_dir).unionByName(IGNORED.files(spark, sf_dir).withColumn("path", F.concat(F.lit("none/"), F.col("path"))))
    broken = METHODS.files(spark, sf_dir).select(F.concat(F.lit("broken/"), F.col("path")).alias("path"), F.concat(F.col("text"), F.lit(_BROKEN)).alias("text"))
    chunks = op.chunks(files.unionByName(broken))
    return chunks.select("path", F.size("fragments").cast("long").alias("n"), F.coalesce(F.array_join(F.transform("fragments", lambda f: f["processedCode"]), "|"), F.lit("")).alias("processed"))


def _chunks_sql() -> str:
    first, second = (sql_normal(METHODS.sql(f)) for f in METHODS.functions)
    path = METHODS.sql(METHODS.path)
    return f"""
SELECT {path} AS path, CAST(2 AS BIGINT) AS n, {first} || '|' || {second} AS processed FROM nation
UNION ALL SELECT 'none/' || {path}, 0, '' FROM nation
UNION ALL SELECT 'broken/' || {path}, 2, {first} || '|' || {second} FROM nation
"""


def parse_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = BROKEN.files(spark, sf_dir).unionByName(METHODS.files(spark, sf_dir)).unionByName(spark.createDataFrame([("undecoded.js", None)], "path string, text string"))
    return op.problems(files)


_PROBLEMS = [(1, "unexpected ')'"), (5, "a bracket is not closed"), (5, "a bracket is not closed"), (7, "a string does not end"), (10, "unexpected ']'"), (11, "a bracket is not closed")]


def _problems_sql() -> str:
    rows = [f"SELECT {BROKEN.sql(BROKEN.path)} AS path, CAST({line} AS INTEGER) AS line, {_sql_text(what)} AS problem FROM nation" for line, what in _PROBLEMS]
    return " UNION ALL ".join([*rows, "SELECT 'undecoded.js', CAST(0 AS INTEGER), 'not text'"])


#: Every eighth order's file is a test, every eighth is minified, and one in eight has Windows line ends.
def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 8
    text = NO_SCOPE.column(NO_SCOPE.text)
    text = F.when(kind == 1, F.concat(text, F.lit("//# sourceMappingURL=x"))).when(kind == 2, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    path = F.concat(F.lit("app/orders_"), F.col("o_orderkey").cast("string"), F.when(kind == 0, ".test.js").otherwise(".js"))
    content = text.cast("binary")
    return rows.select(path.alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def pipeline_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.rows_of(pl.analyse(_order_files(spark, sf_dir), workers=spark.sparkContext.defaultParallelism))


def _pipeline_sql() -> str:
    return f"SELECT * FROM ({NO_SCOPE.rows_sql()}) WHERE CAST(regexp_extract(path, '_(\\d+)', 1) AS BIGINT) % 8 > 1"


# --- lookup (ring X) -------------------------------------------------------


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", nz.normalize_js(F.col("text")).alias("form"))
    return sim.exact_duplicates(rows, "form", "doc_id")


def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sim.cosine_top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10)


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stored index, without loss."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return VectorIndex.build(rows, "vec_id", "embedding", place(spark, "vector-index")).lookup(rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


def _fragment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the scripts built from nations, numbered by nation and first line."""
    found = op.fragments(METHODS.files(spark, sf_dir))
    nation = F.regexp_extract("path", r"_(\d+)", 1).cast("long")
    return found.select((nation * 100 + F.col("start")).alias("id"), "processedCode")


def fragment_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each fragment's vector that are not zero."""
    vectors = _fragment_forms(spark, sf_dir).select("id", F.posexplode(sim.embed(F.col("processedCode"))).alias("bin", "value"))
    return vectors.where("value > 0").select("id", "bin", F.round("value", 6).alias("value"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the scripts built from orders, numbered by order."""
    return NOTES.query()[0](spark, sf_dir).select(F.regexp_extract("path", r"_(\d+)", 1).cast("long").alias("id"), "processedCode")


def weighted_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of each fragment's vector under a model fitted on all of them: forms of the scripts built from orders."""
    found = stored(_notes(spark, sf_dir).select("id", bins_in_batches(F.col("processedCode")).alias("bins")), "bins")
    model = WeightedEmbedding.fit(found, "bins", place(spark, "embedding"))
    return model.embed(found, "bins", "id").select("id", "bin", F.round("value", 6).alias("value"))


def near_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other fragments of each, from a similarity of 0.9 on."""
    return sim.near_duplicates(_fragment_forms(spark, sf_dir), "processedCode", "id", 0.9, 5)


_BINS = f"""
WITH forms AS (
  SELECT CAST(regexp_extract(path, '_(\\d+)', 1) AS BIGINT) * 100 + start AS id, "processedCode" AS p FROM ({METHODS.rows_sql()})
), grams AS (
  SELECT id, p, unnest(range(1, length(p) - {sim.GRAM} + 2)) AS i FROM forms
), bins AS (
  SELECT id, CAST((unicode(substr(p, i, 1)) * {sim.BASE**2} + unicode(substr(p, i + 1, 1)) * {sim.BASE} + unicode(substr(p, i + 2, 1))) % {sim.DIMENSION} AS INTEGER) AS bin, count(*) AS n
  FROM grams GROUP BY ALL
), parts AS (
  SELECT id, bin, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value FROM bins
)"""
_EMBEDDINGS_SQL = _BINS + " SELECT id, bin, round(CAST(value AS DOUBLE), 6) AS value FROM parts"
_NEAR_SQL = (
    _BINS
    + """, pairs AS (
  SELECT a.id AS query_id, b.id AS neighbor_id, round(CAST(sum(a.value * b.value) AS DOUBLE), 6) AS similarity
  FROM parts a JOIN parts b ON a.bin = b.bin AND a.id <> b.id GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5 AND similarity >= 0.9"""
)


_NOTE = 'note() { return ship("«o_orderpriority»", «o_custkey», "«o_orderstatus»"); }'
NOTES = Script("orders", "o_orderkey", "var notes = {\n  " + _NOTE + "\n};\n", [_NOTE])
NEAR = 0.76


def near_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments near every fiftieth one, among those of all scripts built from orders, by an index."""
    found = stored(_notes(spark, sf_dir), "notes")
    index = NearIndex.build(found, "processedCode", "id", place(spark, "near-index"), NEAR)
    return index.lookup(found.where("id % 50 = 0"), "processedCode", "id")


_LOOKUP_SQL = f"""
WITH forms AS (
  SELECT CAST(regexp_extract(path, '_(\\d+)', 1) AS BIGINT) AS id, "processedCode" AS p FROM ({NOTES.rows_sql()})
), sets AS (
  SELECT min(id) AS first_key, count(*) AS copies, list_distinct(list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5))) AS g FROM forms GROUP BY p
), asked AS (
  SELECT id AS query_id, list_distinct(list_transform(range(1, length(p) - 3), lambda i: substr(p, i, 5))) AS q FROM forms WHERE id % 50 = 0
), pairs AS (
  SELECT query_id, first_key, copies, len(list_intersect(g, q)) AS b, len(g) + len(q) - len(list_intersect(g, q)) AS u FROM asked JOIN sets ON len(g) BETWEEN {NEAR} * len(q) - 1e-6 AND len(q) / {NEAR} + 1e-6
)
SELECT query_id, first_key, copies, round(b / u, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(b / u, 6) DESC, first_key) AS INTEGER) AS rank
FROM pairs WHERE b >= {NEAR} * u - 1e-9"""


_WEIGHTED_SQL = f"""
WITH forms AS (
  SELECT CAST(regexp_extract(path, '_(\\d+)', 1) AS BIGINT) AS id, "processedCode" AS p FROM ({NOTES.rows_sql()})
), grams AS (
  SELECT id, CAST(CAST('0x' || substr(md5(substr(p, i, 4)), 1, 8) AS BIGINT) % {DIMENSION} AS INTEGER) AS bin FROM (SELECT id, p, unnest(range(1, length(p) - 2)) AS i FROM forms)
), held AS (
  SELECT bin, ln((1 + (SELECT count(*) FROM forms)) / (1 + count(DISTINCT id))) + 1 AS weight FROM grams GROUP BY bin
), valued AS (
  SELECT id, bin, count(*) * any_value(weight) AS value FROM grams JOIN held USING (bin) GROUP BY id, bin
)
SELECT id, bin, round(value / sqrt(sum(value * value) OVER (PARTITION BY id)), 6) AS value FROM valued"""


_COSINE_SQL = """SELECT query_id, neighbor_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS rank FROM (
               SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
                      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity
               FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 10"""


_PAIRS: dict[str, tuple[Query, str]] = {
    "normalize_documents": _normalize("documents", ["doc_id"], "text"),
    "normalize_pages": _normalize("pages", ["page_id"], "html"),
    "normalize_conversations": _normalize("conversations", ["conv_id", "turn"], "text"),
    "normalize_line_comments": _step("line", nz.drop_line_comments),
    "normalize_block_comments": _step("block", nz.drop_block_comments),
    "normalize_semicolons": _step("semicolon", nz.drop_semicolons),
    "normalize_whitespace": _step("space", nz.drop_white_space),
    "unify_newlines": (unify_newlines, "SELECT doc_id, text || chr(10) || 'last' || chr(10) AS text FROM documents"),
    "exclude_test_paths": (exclude_test_paths, f"SELECT doc_id, {_SQL_PATH} AS path FROM documents WHERE NOT ends_with({_SQL_PATH}, '.test.js')"),
    "exclude_folder": (exclude_folder, f"SELECT doc_id, {_SQL_PATH} AS path FROM documents WHERE NOT list_has_any(string_split({_SQL_PATH}, '/'), ['src0', 'src7'])"),
    "minified_source_map": _marked("//# sourceMappingURL=a.map", el.has_source_map, "source_map"),
    "minified_min_suffix": _marked("x.min.js", el.ends_minified, "min_suffix"),
    "minified_dense_sample": (_dense, _DENSE_SQL),
    "minified_bracket_run": _marked("[[[1]]]", el.has_bracket_run, "bracket_run"),
    "minified_brace_run": _marked("{{{1}}}", el.has_brace_run, "brace_run"),
    "minified_max_line": (max_line, f"SELECT doc_id, CAST({_sql_longest(_X)} AS INTEGER) AS longest, {_sql_longest(_X)} <= 500 AS passes FROM documents"),
    "size_cap": (size_cap, "SELECT doc_id, strlen(text) AS bytes, strlen(text) <= 1000000 AS small, strlen(text) * 100 <= 1000000 AS small_times_100 FROM documents"),
    "eligible_files": (eligible_files, _ELIGIBLE_SQL),
    "turned_away": (turned_away, _TURNED_SQL),
    "changed_list": (changed_list, "SELECT n_nationkey, n_name || '.js' AS path FROM nation UNION ALL SELECT n_nationkey, 'lib/' || n_name || '.js' FROM nation"),
    "line_spans": (line_spans, "SELECT doc_id, CAST(length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS last_line FROM documents"),
    "batches_of_50": (batches_of_50, "SELECT CAST(batch AS BIGINT) AS batch, count(*) AS files, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents) GROUP BY batch"),
    "batches_by_path": (
        batches_by_path,
        f"""SELECT CAST(batch AS BIGINT) AS batch, count(*) AS files, min(path) AS first_path, max(path) AS last_path, CAST(min(before) AS BIGINT) AS bytes_before FROM (
              SELECT path, (row_number() OVER (ORDER BY path) - 1) // 50 AS batch, sum(length) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) - length AS before
              FROM (SELECT {_SQL_PATH} AS path, strlen(text) AS length FROM documents)) GROUP BY batch""",
    ),
    "worker_count": (worker_count, "SELECT source, least(64, 50, count(*)) AS workers FROM documents GROUP BY source"),
    **{name: script.query() for name, script in SCRIPTS.items()},
    "chunks_per_file": (chunks_per_file, _chunks_sql()),
    "pipeline_end_to_end": (pipeline_end_to_end, _pipeline_sql()),
    "exact_duplicates": (exact_duplicates, f"SELECT sha256({sql_normal('text')}) AS digest, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY digest HAVING count(*) > 1"),
    "vector_cosine_topk": (vector_cosine_topk, _COSINE_SQL),
    "vector_index_topk": (vector_index_topk, _COSINE_SQL),
    "fragment_embeddings": (fragment_embeddings, _EMBEDDINGS_SQL),
    "weighted_embeddings": (weighted_embeddings, _WEIGHTED_SQL),
    "near_fragments": (near_fragments, _NEAR_SQL),
    "near_lookup": (near_lookup, _LOOKUP_SQL),
    "parse_problems": (parse_problems, _problems_sql()),
}


def queries() -> dict[str, Query]:
    return {name: pair[0] for name, pair in _PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in _PAIRS.items()}
