"""The engine's operators on the star-schema tables, each with the DuckDB SQL of the same result.

Names are those of the operator inventory. The tables hold no payout sheets, so
grids are made from their columns; the operators are the library's own.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions import scalars as S
from tabulant.operators import client_match as M
from tabulant.operators import detect as D
from tabulant.operators import direct as T
from tabulant.operators import edit_log as L
from tabulant.operators import enrichment as E
from tabulant.operators import export as X
from tabulant.operators import numbering as N
from tabulant.operators import people as P
from tabulant.operators import reference_data as R
from tabulant.operators import reference_document as RD
from tabulant.operators import reference_io as I
from tabulant.operators import validation as V
from tabulant.operators import workbooks as B
from tabulant.sources import grids as G
from tabulant.sources import positioned as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- scans and filters --------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def scan_filter(spark, d):
    """S, P1: rows that are not blank."""
    return _t(spark, d, "documents").where(S.js_trim("text") != "").select("doc_id", "lang", "source")


@query(
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 18, '3') WHEN 1 THEN '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '张三' WHEN 3 THEN '服务费' ELSE 'x' END AS a, CASE WHEN c_custkey % 2 = 0 THEN '12.5' ELSE 'y' END AS b FROM customer)
SELECT c_custkey AS row_idx, a AS first_cell FROM t WHERE regexp_matches(a, '^[0-9A-Za-z]{18}$|^1[3-9][0-9]{9}$|^[0-9]{16,19}$') OR (a = '张三' AND b = '12.5')"""
)
def identity_filter(spark, d):
    """Rows with a strong id, or with a name and an amount among three filled cells."""
    k = F.col("c_custkey")
    a = F.when(k % 5 == 0, F.lpad(_text("c_custkey"), 18, "3")).when(k % 5 == 1, F.concat(F.lit("138"), F.lpad(_text("c_custkey"), 8, "0"))).when(k % 5 == 2, "张三").when(k % 5 == 3, "服务费").otherwise("x")
    cells = F.array(a, F.when(k % 2 == 0, "12.5").otherwise("y"), F.lit("note"))
    rows = _t(spark, d, "customer").select(k.alias("row_idx"), cells.alias("cells"))
    return rows.where(D.has_identity(F.col("cells"), F.array(F.lit("姓名"), F.lit("金额"), F.lit("备注")))).select("row_idx", F.get("cells", F.lit(0)).alias("first_cell"))


@query("""SELECT p_partkey AS row_idx, p_name AS first_cell FROM part WHERE p_partkey % 7 <> 0""")
def summary_row_filter(spark, d):
    """Injected total rows go."""
    part = _t(spark, d, "part")
    cells = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit(" "), F.concat(F.lit("合计 "), "p_name"))).otherwise(F.array("p_name", "p_type"))
    return part.select(F.col("p_partkey").alias("row_idx"), cells.alias("cells")).where(~D.is_total_row(F.col("cells"))).select("row_idx", F.get("cells", F.lit(0)).alias("first_cell"))


@query(
    """WITH s AS (SELECT p_brand AS source_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
h AS (SELECT source_id, p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS score FROM s WHERE rn <= 30)
SELECT source_id, arg_max(p_partkey, (score, -p_partkey)) AS header_row FROM h GROUP BY source_id"""
)
def header_score(spark, d):
    """The best of the first thirty rows of each source, the earliest of equals; a sequence number is half a hit."""
    k = F.col("p_partkey")
    words = F.when(k % 4 == 0, F.array(*map(F.lit, ("序号", "姓名", "手机")))).when(k % 4 == 1, F.array(*map(F.lit, ("姓名", "身份证", "金额")))).when(k % 4 == 2, F.array(F.lit("金额"), F.lit("7"), F.lit("")))
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("source_id"), k.alias("row_idx"), F.coalesce(words, F.array(*map(F.lit, ("7", "8", "9")))).alias("cells"))
    return D.header_rows(rows).select("source_id", "header_row")


_PROFILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100) AS rn FROM lineitem), h AS (SELECT * FROM r WHERE rn <= 12) "
    + " UNION ALL ".join(
        f"SELECT l_returnflag AS source_id, {i} AS col_idx, count(*) AS filled12, count(*) FILTER (WHERE try_cast({c} AS DOUBLE) > 0) AS amounts12 FROM h GROUP BY l_returnflag"
        for i, c in enumerate(_PROFILE_COLUMNS)
    )
)
def column_profile(spark, d):
    """Amounts among the first twelve cells of each column."""
    at = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100
    cells = F.array(*[S.number_text(F.col(c)) if c not in ("l_returnflag", "l_linestatus") else F.col(c) for c in _PROFILE_COLUMNS])
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("source_id"), at.alias("row_idx"), cells.alias("cells"))
    heads = rows.select("source_id").distinct().withColumn("header", F.array(*map(F.lit, _PROFILE_COLUMNS)))
    return D.column_profile(heads, rows).select("source_id", "col_idx", "filled12", "amounts12")


@query(
    """WITH r AS (SELECT o_orderpriority AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 16, '6') ELSE 'bank ' || o_custkey END AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)
SELECT source_id, 0 AS col_idx, count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{10,23}')) AS cards12, count(*) AS filled12 FROM r WHERE rn <= 12 GROUP BY source_id"""
)
def card_like_ratio(spark, d):
    """Card numbers among the first twelve cells."""
    v = F.when(F.col("o_orderkey") % 3 == 0, F.lpad(_text("o_orderkey"), 16, "6")).otherwise(F.concat(F.lit("bank "), _text("o_custkey")))
    rows = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").alias("row_idx"), F.array(v).alias("cells"))
    heads = rows.select("source_id").distinct().withColumn("header", F.array(F.lit("银行")))
    return D.column_profile(heads, rows).select("source_id", "col_idx", "cards12", "filled12")


def _sum_grid(spark, d):
    li = _t(spark, d, "lineitem")
    net, tax = F.round("l_extendedprice", 2), F.round(F.col("l_extendedprice") * F.col("l_tax") + 1, 2)
    cells = F.array(S.number_text(net), S.number_text(tax), S.number_text(F.round(net + tax, 2)), S.number_text(F.col("l_quantity")))
    return li.select(F.col("l_returnflag").alias("source_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("row_idx"), cells.alias("cells"))


@query("SELECT DISTINCT l_returnflag AS source_id, 2 AS total_col, '0,1' AS split_cols FROM lineitem")
def sum_arbitration(spark, d):
    """The column that others sum up to, found by enumerating subsets."""
    grid = _sum_grid(spark, d)
    cands = grid.select("source_id").distinct().withColumn("cols", F.array(*map(F.lit, range(4))))
    return D.sum_relations(grid, cands).select("source_id", "total_col", F.array_join(F.col("split_cols").cast("array<string>"), ",").alias("split_cols"))


# --- splitting and reconciling ------------------------------------------------


@query(
    """WITH t AS (SELECT o_orderkey AS row_idx, o_orderkey % 5 AS a, o_custkey % 3 AS b FROM orders)
SELECT row_idx, 0 AS split_idx, CAST(a AS VARCHAR) AS amount, '' AS other, 'n；第一笔' AS note FROM t WHERE a <> 0
UNION ALL SELECT row_idx, 1, CAST(b AS VARCHAR), '', CASE WHEN row_idx % 2 = 0 THEN 'n；' ELSE '' END || '第二笔' FROM t WHERE b <> 0
UNION ALL SELECT row_idx, 0, '0', '0', CASE WHEN row_idx % 2 = 0 THEN 'n' ELSE '' END FROM t WHERE a = 0 AND b = 0""".replace("'n；第一笔'", "CASE WHEN row_idx % 2 = 0 THEN 'n；' ELSE '' END || '第一笔'")
)
def amount_split(spark, d):
    """One row per amount that is not zero, as written, labelled in the note; every second row is too short for a note."""
    k = F.col("o_orderkey")
    cells = F.array((k % 5).cast("string"), (F.col("o_custkey") % 3).cast("string"))
    rows = _t(spark, d, "orders").select(F.lit("s").alias("source_id"), k.alias("row_idx"), F.when(k % 2 == 0, F.concat(cells, F.array(F.lit("n")))).otherwise(cells).alias("cells"))
    out, _ = P.split_amounts(rows, [0, 1], note_col=2, labels={0: "第一笔", 1: "第二笔"}, label_note=True)
    cell = lambda i, n: F.get("cells", F.lit(i)).alias(n)
    return out.select("row_idx", "split_idx", cell(0, "amount"), cell(1, "other"), cell(2, "note"))


@query("SELECT o_orderkey AS row_idx, CAST(o_custkey % 9 + o_orderkey % 4 AS DOUBLE) AS sum, CAST(o_custkey % 9 + o_orderkey % 4 + 5 AS DOUBLE) AS declared FROM orders WHERE o_orderkey % 3 = 0")
def reconcile(spark, d):
    """Declared totals that the parts don't make up; a total that is no number is not held against them."""
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 9, F.col("o_orderkey") % 4
    total = F.when(k % 3 == 1, "-").otherwise((a + b + F.when(k % 3 == 0, 5).otherwise(0)).cast("string"))
    rows = _t(spark, d, "orders").select(F.lit("s").alias("source_id"), k.alias("row_idx"), F.array(a.cast("string"), b.cast("string"), total).alias("cells"))
    return P.row_mismatches(rows, [0, 1], 2).select("row_idx", "sum", "declared")


@query("""SELECT l_returnflag AS source_id, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS declared, true AS ok FROM lineitem GROUP BY l_returnflag""")
def column_total(spark, d):
    """An injected total row against the sum of the data rows."""
    li = _t(spark, d, "lineitem")
    data = li.select(F.col("l_returnflag").alias("source_id"), F.lit(0).alias("row_idx"), F.array(_text("l_quantity")).alias("cells"))
    totals = li.groupBy(F.col("l_returnflag").alias("source_id")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("string").alias("t"))
    out = P.column_totals(data, totals.select("source_id", F.lit(1).alias("row_idx"), F.array("t").alias("cells")), [0])
    return out.select("source_id", "declared", "ok")


# --- merging ------------------------------------------------------------------


def _people(spark, d):
    """Orders as a sheet: name, phone, priority, amount, note, per status."""
    o = _t(spark, d, "orders")
    cells = F.array(F.concat(F.lit("客户 "), _text("o_custkey")), _text("o_custkey"), F.col("o_orderpriority"), F.format_string("%.2f", F.col("o_totalprice")), F.lit(""))
    return o.select(F.col("o_orderstatus").alias("source_id"), F.col("o_orderkey").alias("row_idx"), cells.alias("cells"))


_KEYED = "SELECT o_orderstatus AS source_id, o_custkey, min(o_orderkey) AS row_idx, count(*) AS members, count(DISTINCT o_orderpriority) AS kinds, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS amount, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY ALL"


@query(f"WITH g AS ({_KEYED}) SELECT source_id, 'np:客户' || o_custkey || '|' || o_custkey AS key, members FROM g WHERE members > 1")
def dup_probe(spark, d):
    """Keys that occur twice or more, without merging."""
    _, groups = P.merge_people(_people(spark, d), {"name": 0, "phone": 1}, [3])
    return groups.select("source_id", "key", "members")


@query(f"WITH g AS ({_KEYED}) SELECT source_id, row_idx, amount FROM g")
def merge_groups(spark, d):
    """A1, A3, A4: the merged rows with exact sums."""
    rows, _ = P.merge_people(_people(spark, d), {"name": 0, "phone": 1}, [3], merge=True)
    return rows.select("source_id", "row_idx", F.get("cells", F.lit(3)).alias("amount"))


@query(f"WITH g AS ({_KEYED}) SELECT source_id, 'np:客户' || o_custkey || '|' || o_custkey AS key, members FROM g WHERE kinds > 1")
def merge_conflicts(spark, d):
    """A2: groups whose typed columns differ."""
    _, groups = P.merge_people(_people(spark, d), {"name": 0, "phone": 1, "gender": 2}, [3])
    return groups.where(F.size("conflicts") > 0).select("source_id", "key", "members")


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders GROUP BY o_custkey")
def merge_sum(spark, d):
    """A3: exact decimal sums at the scale of the inputs."""
    return _t(spark, d, "orders").groupBy("o_custkey").agg(P.exact_sum(F.format_string("%.2f", F.col("o_totalprice"))).alias("total"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 5 <> 0) AS first_priority FROM orders GROUP BY o_custkey")
def first_value(spark, d):
    """A4: the first value that is not blank."""
    v = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).otherwise(F.lit(" "))
    return _t(spark, d, "orders").groupBy("o_custkey").agg(P.first_filled(v, F.col("o_orderkey")).alias("first_priority"))


@query(
    """WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(v, '、' ORDER BY k) AS texts FROM f GROUP BY o_custkey"""
)
def text_diff(spark, d):
    """A5: distinct values in the order they appear."""
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(P.distinct_in_order(F.col("o_orderpriority"), F.col("o_orderkey")), "、").alias("texts"))


# --- scalars --------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal AS amount FROM customer")
def money_clean(spark, d):
    """dirty money text and back."""
    dirty = F.concat(F.lit(" ¥"), F.format_string("%,.2f", F.col("c_acctbal")), F.lit("元"))
    return _t(spark, d, "customer").select("c_custkey", S.sanitize_amount(dirty).cast("double").alias("amount"))


@query("SELECT c_custkey, 'CUSTOMER' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name FROM customer")
def value_clean(spark, d):
    """white space, zero-width and full-width characters."""
    dirty = F.concat(F.lit("　ＣＵＳ TOMER​"), F.lpad(F.translate(_text("c_custkey"), "0123456789", "０１２３４５６７８９"), 9, "０"), F.lit(" "))
    return _t(spark, d, "customer").select("c_custkey", S.clean_value(dirty, "name").alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '王辉' WHEN c_custkey % 3 = 1 THEN '陈建新' ELSE '武汉市红枫咨询商行2' END AS name FROM customer")
def name_clean(spark, d):
    """notes beside names go, organisations stay."""
    k = F.col("c_custkey") % 3
    dirty = F.when(k == 0, F.concat(F.lit("王 辉"), _text("c_custkey"))).when(k == 1, F.lit("陈建新（补发）")).otherwise(F.lit("武汉市红枫咨询商行2"))
    return _t(spark, d, "customer").select("c_custkey", S.clean_name(dirty).alias("name"))


_CHECK_SQL = " + ".join(f"CAST(substr(b, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(C.ID_WEIGHTS))


@query(
    f"""WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 17, '1') AS b FROM customer)
SELECT c_custkey, substr('{C.ID_CHECKS}', ({_CHECK_SQL}) % 11 + 1, 1) = CAST(c_custkey % 10 AS VARCHAR) AS valid FROM b"""
)
def id_checksum(spark, d):
    """checksum of 18-digit ids."""
    ids = F.concat(F.lpad(_text("c_custkey"), 17, "1"), (F.col("c_custkey") % 10).cast("string"))
    return _t(spark, d, "customer").select("c_custkey", S.id_checksum_valid(ids).alias("valid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN '男' ELSE '女' END AS gender FROM customer")
def gender_digit(spark, d):
    """Gender by the 17th digit of an id."""
    return _t(spark, d, "customer").select("c_custkey", S.gender_of_id(F.concat(F.lpad(_text("c_custkey"), 17, "1"), F.lit("x"))).alias("gender"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS seq, p_name AS name, 'T' || p_partkey AS id FROM part")
def parse_task(spark, d):
    """``seq.name(id)`` parsed."""
    made = _t(spark, d, "part").select("p_partkey", F.concat(_text("p_size"), F.lit("."), "p_name", F.lit("(T"), _text("p_partkey"), F.lit(")")).alias("entry"))
    return R.client_tasks(made, "entry").select("p_partkey", "seq", "name", "id")


@query(
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1.提供家政服务(9)' WHEN 1 THEN '2.快递配送(8)' WHEN 2 THEN '3.从事绿化养护工作(7)' WHEN 3 THEN '4.直播摄影(6)' WHEN 4 THEN '5.培训讲师(5)' ELSE '6.植保(4)' END AS task, CASE WHEN p_size % 5 = 0 THEN '数据标注' ELSE '' END AS content FROM part) SELECT p_partkey, CASE "
    + " ".join(f"WHEN regexp_matches(content || ' ' || task, '{r}') THEN '{v}'" for v, r in C.WORK_TYPES)
    + " WHEN p_partkey % 6 = 2 THEN '绿化养护' ELSE '植保' END AS work_type FROM t"
)
def work_type(spark, d):
    """the first rule that content and task name meet; else the named service; else the task's name."""
    k = F.col("p_partkey") % 6
    names = ("1.提供家政服务(9)", "2.快递配送(8)", "3.从事绿化养护工作(7)", "4.直播摄影(6)", "5.培训讲师(5)", "6.植保(4)")
    content = F.when(F.col("p_size") % 5 == 0, "数据标注").otherwise("")
    return _t(spark, d, "part").select("p_partkey", V.work_type(F.get(F.array(*map(F.lit, names)), k.cast("int")), content).alias("work_type"))


@query()
def crc(spark, d):
    """CRC-32 (no such function in the oracle's SQL)."""
    return _t(spark, d, "customer").select("c_custkey", F.crc32("c_name").alias("crc"))


_HAN = ("阿", "八", "陈", "王", "张", "晟", "李", "重", "赵", "欧")


@query("SELECT c_custkey, (['A','B','C','W','Z','S','L','C','Z','O'])[c_custkey % 10 + 1] AS initial FROM customer")
def pinyin_initial(spark, d):
    """initials by Chinese collation, with exceptions."""
    ch = F.get(F.array(*map(F.lit, _HAN)), (F.col("c_custkey") % 10).cast("int"))
    return _t(spark, d, "customer").select("c_custkey", S.pinyin_initial(ch).alias("initial"))


# --- lookups -------------------------------------------------------------------


@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_id(spark, d):
    """Left join by trimmed id."""
    clients = _t(spark, d, "nation").select(_text("n_nationkey").alias("id"), "n_name", "n_regionkey")
    rows = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), _text("c_nationkey"), F.lit("　")).alias("key"))
    return R.lookup_id(rows, "key", clients).select("c_custkey", "n_name", "n_regionkey")


@query("SELECT s_suppkey, n_nationkey AS pos FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def lookup_taxid(spark, d):
    """Case aside, the first client of a tax id."""
    clients = _t(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("tax_id"))
    clients = clients.union(clients.select((F.col("pos") + 100).alias("pos"), "tax_id"))
    rows = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("nation_"), _text("s_nationkey"), F.lit(" ")).alias("key"))
    return R.lookup_tax_id(rows, "key", clients).select("s_suppkey", "pos")


_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS q FROM part"


def _clients(spark, d):
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("full_name"), F.lower("p_brand").alias("short_name"))


def _name_queries(spark, d):
    return _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("q")).distinct()


_RANK3 = "CASE WHEN p_name = q THEN 1 WHEN lower(p_brand) = q THEN 2 WHEN contains(p_name, q) OR contains(lower(p_brand), q) OR contains(q, p_name) OR contains(q, lower(p_brand)) THEN 3 END"
_RANK4 = "CASE WHEN p_name = q THEN 1 WHEN lower(p_brand) = q THEN 2 WHEN contains(p_name, q) OR contains(lower(p_brand), q) THEN 3 WHEN contains(q, p_name) OR contains(q, lower(p_brand)) THEN 4 END"


@query(f"WITH w AS ({_WORDS}) SELECT q, p_partkey AS pos, {_RANK3} AS match_rank FROM w JOIN part ON {_RANK3} IS NOT NULL")
def lookup_name_all(spark, d):
    """Containment join with ranks, with every part as a client."""
    return R.lookup_name_all(_name_queries(spark, d), "q", _clients(spark, d)).select("q", "pos", "match_rank")


@query(f"WITH w AS ({_WORDS}), m AS (SELECT q, p_partkey AS pos, {_RANK4} AS match_rank FROM w JOIN part ON {_RANK4} IS NOT NULL) SELECT q, arg_min(pos, (match_rank, pos)) AS pos FROM m GROUP BY q")
def lookup_name_first(spark, d):
    """The first match by phase and position, with every part as a client."""
    return R.lookup_name_first(_name_queries(spark, d), "q", _clients(spark, d)).select("q", "pos")


_MAPPING = (("NATION_1", ("ASIA", "AME")), ("NATION_12", ("EUR",)), ("NATION_2", ("nowhere", "AFR")))


@query(
    """WITH r AS (SELECT * FROM region) SELECT n_nationkey, coalesce(
  CASE WHEN contains(n_name, 'NATION_12') THEN (SELECT arg_min(r_name, r_regionkey) FROM r WHERE contains(r_name, 'EUR')) END,
  CASE WHEN contains(n_name, 'NATION_1') THEN coalesce((SELECT arg_min(r_name, r_regionkey) FROM r WHERE contains(r_name, 'ASIA')), (SELECT arg_min(r_name, r_regionkey) FROM r WHERE contains(r_name, 'AME'))) END,
  CASE WHEN contains(n_name, 'NATION_2') THEN (SELECT arg_min(r_name, r_regionkey) FROM r WHERE contains(r_name, 'AFR')) END, '') AS platform FROM nation"""
)
def entity_platform(spark, d):
    """Keys by length, then keywords, then platforms in order."""
    lists = _t(spark, d, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: s["r_name"]).alias("platforms"))
    rows = _t(spark, d, "nation").crossJoin(F.broadcast(lists))  # one row
    return rows.select("n_nationkey", R.entity_platform(F.col("n_name"), F.col("platforms"), _MAPPING).alias("platform"))


@query("SELECT n_nationkey, CASE WHEN contains(n_name, '_1') THEN 'T1' WHEN contains(n_name, '2') THEN 'T2' ELSE '' END AS tax FROM nation")
def platform_tax(spark, d):
    """The first keyword contained."""
    return _t(spark, d, "nation").select("n_nationkey", R.platform_tax(F.col("n_name"), (("_1", "T1"), ("2", "T2"))).alias("tax"))


@query(
    r"""WITH h AS (SELECT conv_id, turn, nullif(trim(regexp_extract(text, '(?:de|the)[ ]+(\S+)', 1)), '') AS value FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS source_id, arg_min(value, turn) AS value FROM h WHERE value IS NOT NULL GROUP BY conv_id"""
)
def client_detect(spark, d):
    """The first labelled value by row and column."""
    conv = _t(spark, d, "conversations")
    cell = F.concat(F.lit("客户："), F.regexp_extract("text", r"(?:de|the)[ ]+(\S+)", 1))
    grid = conv.select(_text("conv_id").alias("source_id"), F.col("turn").alias("row_idx"), F.array(cell).alias("cells"))
    return R.label_values(grid, "客户")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority WHEN c_mktsegment IS NOT NULL THEN c_mktsegment ELSE '' END AS filled FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fill_if_empty(spark, d):
    """Current values win over looked-up ones."""
    o = _t(spark, d, "orders").withColumn("cur", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise(F.lit("")))
    j = o.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", R.fill_if_empty(F.col("cur"), F.col("c_mktsegment")).alias("filled"))


def _payout_clients(spark, d):
    """Nations as clients: entities that lead to platforms by mapping, by mapping past a keyword, by likeness, or not at all; up to two tasks."""
    k = F.col("n_nationkey")
    entity = F.get(F.array(*map(F.lit, ("佛山云杉人力资源有限公司", "广州国联服务", "咸宁合用工公司", "深圳云杉", None))), (k % 5).cast("int"))
    task = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(c).alias("content"))
    tasks = F.when(k % 3 == 0, F.array(task("保洁服务", "打扫"), task("其他", ""))).when(k % 3 == 1, F.array(task("植保", None))).otherwise(F.array().cast("array<struct<name:string,content:string>>"))
    return _t(spark, d, "nation").select(k.cast("string").alias("id"), k.alias("pos"), F.col("n_name").alias("full_name"), F.lit("").alias("short_name"), F.lit("").alias("tax_id"), entity.alias("sign_entity"), tasks.alias("tasks"))


def _payout_tasks(spark, d):
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").where(k % 6 == 5).select(k.alias("pos"), F.concat(F.lit("9"), k, F.lit(".直播("), k, F.lit(")")).alias("entry"))


def _payout_rows(spark, d):
    k, empty = F.col("c_custkey"), F.lit("")
    key = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" "), "c_nationkey", F.lit("　"))).when(k % 4 == 2, "999").otherwise(_text("c_nationkey"))
    return _t(spark, d, "customer").select(
        "c_custkey", key.alias(E.CLIENT), F.when(k % 5 == 0, "409.天津税地（身边云）5.6%").otherwise("").alias(E.PLATFORM),
        F.when(k % 7 == 0, "T").otherwise("").alias(E.TAX), F.when(k % 11 == 0, "1.x(1)").otherwise("").alias(E.TASK), empty.alias(E.WORK), F.when(k % 13 == 0, "开车").otherwise("").alias("note"),
    )


_CLIENTS_SQL = """c AS (SELECT n_nationkey AS pos, CAST(n_nationkey AS VARCHAR) AS id, ['278.甲乙科技', '356.国联信宜', '379.咸宁合用工6.1%', '', ''][n_nationkey % 5 + 1] AS platform, ['0001.湖南', '0005.信宜', '0006.湖北', '', ''][n_nationkey % 5 + 1] AS tax, [2, 1, 0][n_nationkey % 3 + 1] AS n FROM nation),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS seq FROM c),
l AS (SELECT id, platform, tax, CASE WHEN pos % 6 = 5 THEN '9' || pos || '.直播(' || pos || ')' WHEN pos % 3 = 0 THEN seq || '.保洁服务(' || id || ')' WHEN pos % 3 = 1 THEN seq || '.植保(' || id || ')' END AS task,
      CASE WHEN pos % 6 = 5 THEN '摄影' WHEN pos % 3 = 0 THEN '保洁' WHEN pos % 3 = 1 THEN '植保' END AS work FROM s),
r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 3 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN '999' ELSE '' END AS id, CASE WHEN c_custkey % 5 = 0 THEN '409.天津税地（身边云）5.6%' ELSE '' END AS p,
      CASE WHEN c_custkey % 7 = 0 THEN 'T' ELSE '' END AS t, CASE WHEN c_custkey % 11 = 0 THEN '1.x(1)' ELSE '' END AS k, c_custkey % 13 = 0 AS drives FROM customer)"""


@query(
    f"""WITH {_CLIENTS_SQL}
SELECT c_custkey, CASE WHEN p <> '' OR l.id IS NULL THEN p ELSE platform END AS platform, CASE WHEN t <> '' OR l.id IS NULL THEN t WHEN p <> '' THEN '0007.天津' ELSE tax END AS tax_source,
CASE WHEN k <> '' OR l.id IS NULL THEN k ELSE coalesce(task, '') END AS task, CASE WHEN l.id IS NULL OR work IS NULL THEN '' WHEN drives AND work <> '保洁' THEN '司机' ELSE work END AS work_type, l.id IS NULL AS unmatched
FROM r LEFT JOIN l USING (id)"""
)
def enrich_rows(spark, d):
    """Platform, tax source of the row's platform, first task and work type, where empty; unmatched rows."""
    lookup = E.client_lookup(_payout_clients(spark, d), E.Config(), _payout_tasks(spark, d))
    rows = E.enrich_rows(_payout_rows(spark, d), lookup, text=E.RowText(("note",)))
    return rows.select("c_custkey", F.col(E.PLATFORM).alias("platform"), F.col(E.TAX).alias("tax_source"), F.col(E.TASK).alias("task"), F.col(E.WORK).alias("work_type"), "unmatched")


@query("WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS row_no FROM customer) SELECT row_no, c_custkey FROM r LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 4 IN (1, 3) WHERE n_nationkey IS NULL")
def unmatched(spark, d):
    """The numbers of rows whose client is empty or unknown, out of the same plan."""
    rows = N.numbered(_payout_rows(spark, d), ["c_custkey"])
    return E.enrich_rows(rows, E.client_lookup(_payout_clients(spark, d))).where("unmatched").select("row_no", "c_custkey")


@query(
    f"""WITH {_CLIENTS_SQL}, t AS (SELECT pos, id, seq, pos % 6 = 5 AS listed FROM s)
SELECT id, 0 AS n, CAST('9' || pos AS BIGINT) AS seq, '直播' AS name, '' AS content FROM t WHERE listed
UNION ALL SELECT id, 0, seq, CASE WHEN pos % 3 = 0 THEN '保洁服务' ELSE '植保' END, CASE WHEN pos % 3 = 0 THEN '打扫' ELSE '' END FROM t WHERE NOT listed AND pos % 3 <> 2
UNION ALL SELECT id, 1, seq + 1, '其他', '' FROM t WHERE NOT listed AND pos % 3 = 0"""
)
def tasks_of_clients(spark, d):
    """Entries of the task list first, else a client's own tasks with running numbers."""
    tasks = E.tasks_of_clients(_payout_clients(spark, d), _payout_tasks(spark, d))
    return tasks.select("id", F.row_number().over(Window.partitionBy("id").orderBy("n")).alias("n"), "seq", "name", "content").withColumn("n", F.col("n") - 1)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '349.河南雅文' WHEN c_custkey % 5 = 0 THEN '409.天津税地（身边云）5.6%' ELSE '' END AS platform, CASE WHEN c_custkey % 3 = 0 THEN '0003.河南' WHEN c_custkey % 7 = 0 THEN 'T' ELSE '' END AS tax_source FROM customer")
def set_platform(spark, d):
    """A platform chosen for rows; the tax source follows."""
    rows = E.set_platform(_payout_rows(spark, d), "349.河南雅文", F.col("c_custkey") % 3 == 0)
    return rows.select("c_custkey", F.col(E.PLATFORM).alias("platform"), F.col(E.TAX).alias("tax_source"))


@query(
    f"""WITH {_CLIENTS_SQL}, e AS (SELECT c_custkey, k, drives, c_custkey % 2 = 0 AS chosen, c_custkey % 3 = 0 AS known, (SELECT task FROM l WHERE id = '3') AS own FROM r)
SELECT c_custkey, CASE WHEN NOT chosen THEN k WHEN known THEN own ELSE '5.提供绿化养护工作(8)' END AS task,
CASE WHEN NOT chosen THEN '' WHEN drives AND NOT known THEN '司机' WHEN known THEN '保洁' ELSE '绿化养护' END AS work_type FROM e"""
)
def set_task(spark, d):
    """A task chosen for rows, and the work type that follows from its content, the note and its name."""
    tasks = E.tasks_of_clients(_payout_clients(spark, d), _payout_tasks(spark, d))
    own = tasks.where("id = '3'").groupBy().agg(F.min_by("full", "n").alias("own"))  # one row
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("own")).otherwise("5.提供绿化养护工作(8)")
    rows = E.set_task(_payout_rows(spark, d).crossJoin(F.broadcast(own)), value, F.col("c_custkey") % 2 == 0, tasks, E.RowText(("note",)))
    return rows.select("c_custkey", F.col(E.TASK).alias("task"), F.col(E.WORK).alias("work_type"))


@query("SELECT count(DISTINCT o_custkey) AS known FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def crossref(spark, d):
    """Distinct uploaded ids that are known."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.agg(F.countDistinct("o_custkey").alias("known"))


# --- upserts and lists -----------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_rows FROM events GROUP BY user_id")
def upsert(spark, d):
    """The latest value per key wins."""
    e = _t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return R.upsert(e, "user_id", "o", ["event_type"])


@query(
    """WITH o AS (SELECT n_name AS key, n_regionkey AS value, n_nationkey AS pos FROM nation WHERE n_nationkey < 15), n AS (SELECT n_name AS key, n_regionkey + 10 AS value, n_nationkey AS pos FROM nation WHERE n_nationkey >= 10)
SELECT key, coalesce(n.value, o.value) AS value, row_number() OVER (ORDER BY o.pos IS NULL, o.pos, n.pos) AS pos, o.pos IS NULL AS added FROM o FULL JOIN n USING (key)"""
)
def map_merge(spark, d):
    """New values win, new keys follow."""
    n = _t(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"), F.col("n_nationkey").alias("pos"))
    return R.merge_maps(n.where("pos < 15"), n.where("pos >= 10").withColumn("value", F.col("value") + 10))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey < 10 DESC, n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def list_union(spark, d):
    """Old order first, then what is new."""
    part = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n_nationkey", "n_name")))), lambda s: s["n_name"])
    g = _t(spark, d, "nation").groupBy("n_regionkey").agg(part(F.col("n_nationkey") < 10).alias("old"), part(F.col("n_nationkey") >= 5).alias("new"))
    return g.select("n_regionkey", F.array_join(R.list_union(F.col("old"), F.col("new")), ",").alias("names"))


def _tasks(spark, d):
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("content")))).alias("tasks"))
    r = _t(spark, d, "region").join(n.where("n_regionkey <> 2"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("pos"), F.coalesce("tasks", F.array().cast("array<struct<name:string,content:string>>")).alias("tasks"))


@query("SELECT r_name AS id, row_number() OVER (ORDER BY r_regionkey, n_name) AS seq, n_name AS name FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey <> 2")
def task_seq(spark, d):
    """One running number over all tasks."""
    return R.numbered_tasks(_tasks(spark, d)).select("id", "seq", "name")


@query("SELECT r_name AS id, coalesce(n_name, '') AS task_name FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def dim_flatten(spark, d):
    """One row per task, one for clients without."""
    return R.flatten_tasks(_tasks(spark, d)).select("id", "task_name")


@query(
    """WITH a AS (SELECT r_name AS a, row_number() OVER (ORDER BY r_regionkey) AS k FROM region), b AS (SELECT n_name AS b, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)
SELECT coalesce(a, '') AS a, coalesce(b, '') AS b FROM a FULL JOIN b USING (k)"""
)
def zip_lists(spark, d):
    """Two lists side by side."""
    lists = lambda t, o, v: _t(spark, d, t).agg(F.transform(F.array_sort(F.collect_list(F.struct(o, v))), lambda s: s[v]).alias("l"))
    both = lists("region", "r_regionkey", "r_name").withColumnRenamed("l", "x").crossJoin(lists("nation", "n_nationkey", "n_name").withColumnRenamed("l", "y"))  # one row each
    return both.select(F.inline(R.zip_lists(F.col("x"), F.col("y"))))


# --- groups, facets, limits --------------------------------------------------------


def _sheets(spark, d):
    return _t(spark, d, "documents").select(F.col("source").alias("_file"), F.col("lang").alias("_sheet"), F.col("doc_id").alias("row_idx"))


@query("SELECT source AS file, lang AS sheet, min(doc_id) AS first_row, count(*) AS n_rows FROM documents GROUP BY source, lang")
def split_group(spark, d):
    """Groups by file and sheet."""
    return X.split_groups(_sheets(spark, d), True)


@query("SELECT source AS file, '' AS sheet, min(doc_id) AS first_row, count(*) AS n_rows FROM documents GROUP BY source")
def file_groups(spark, d):
    """Rows per file."""
    return X.split_groups(_sheets(spark, d), False)


@query("SELECT count(DISTINCT source) AS files, count(DISTINCT source || '|' || lang) AS sheets FROM documents")
def counts(spark, d):
    """Distinct files and sheets."""
    return _sheets(spark, d).agg(F.countDistinct("_file").alias("files"), F.countDistinct("_file", "_sheet").alias("sheets"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def facet(spark, d):
    """The values of a column."""
    return _t(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND user_id IN (1, 2, 3, 5, 8)")
def filter_in(spark, d):
    """A conjunction of IN sets."""
    return _t(spark, d, "events").where(F.col("event_type").isin("click", "error") & F.col("user_id").isin(1, 2, 3, 5, 8)).select("event_id", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(trim(p_name)), 'ring') ORDER BY p_partkey LIMIT 50")
def search_top50(spark, d):
    """The first fifty that contain a text."""
    return _t(spark, d, "part").where(F.contains(F.lower(S.js_trim("p_name")), F.lit("ring"))).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 8")
def preview(spark, d):
    """The first rows by position."""
    return _t(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(8)


@query("SELECT c_custkey, c_mktsegment || '-' || chr(CAST(64 + least(26, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS INT)) AS batch_no FROM customer")
def batch_dedupe(spark, d):
    """Letters for equal batch numbers."""
    return X.lettered_batches(_t(spark, d, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "batch_no")


@query("WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '(' || k || ')' END AS name FROM n")
def name_dedupe(spark, d):
    """Numbers for equal file names."""
    return X.numbered_names(_t(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "name")


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS new FROM e)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f"""
)
def row_cluster(spark, d):
    """Gaps and islands."""
    e = _t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return P.row_clusters(e, ["user_id"], "t", 3600.0).select("event_id", "cluster")


@query("SELECT event_id AS row_idx, CASE WHEN value < 9.5 THEN event_type || '||' WHEN value < 24.5 THEN '|' || event_type || '|' ELSE '||' || event_type END AS cells FROM events WHERE value >= 0 AND value < 9e17")
def interval_assign(spark, d):
    """Each word to the band that it overlaps most, the first of equals."""
    words = _t(spark, d, "events").where("value >= 0 and value < 9e17").select(F.lit("s").alias("source_id"), F.col("event_id").alias("row_idx"), F.col("event_type").alias("str"), (F.col("value") + 0.0001).alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("w"))
    bands = spark.sql("SELECT * FROM VALUES ('s', 0, 0D, 10D), ('s', 1, 10D, 25D), ('s', 2, 25D, 1e18D) AS b(source_id, col_idx, a, b)")
    return G.cells_by_overlap(words, bands).select("row_idx", F.array_join("cells", "|").alias("cells"))


# --- projections ----------------------------------------------------------------


_TEMPLATE = X.Template("payout", ("姓名", "身份证", "金额", "性别", "备注", "税额"), (("name", "姓名"), ("idCard", "身份证"), ("amount", "金额"), ("gender", "性别")))


@query(
    """WITH i AS (SELECT c_custkey, 'C' || c_custkey AS n, lpad(CAST(c_custkey AS VARCHAR), 17, '3') || 'X' AS id FROM customer)
SELECT i.c_custkey AS row_idx, n AS "姓名", id AS "身份证", CASE WHEN i.c_custkey % 2 = 1 THEN '男' ELSE '女' END AS "性别", '' AS "备注", "金额" FROM (SELECT i.*, regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS "金额" FROM i JOIN customer USING (c_custkey)) AS i"""
)
def template_project(spark, d):
    """Typed columns under a template's headers."""
    c = _t(spark, d, "customer")
    cells = F.array(F.concat(F.lit(" C "), _text("c_custkey")), F.concat(F.lpad(_text("c_custkey"), 17, "3"), F.lit("x")), S.number_text(F.col("c_acctbal")))
    rows = c.select(F.lit("s").alias("source_id"), F.col("c_custkey").alias("row_idx"), cells.alias("cells"))
    return X.project(rows, {"name": 0, "idCard": 1, "amount": 2}, _TEMPLATE).select("row_idx", "姓名", "身份证", "性别", "备注", "金额")


@query("""SELECT s_suppkey, '0' AS "个税金额", '0' AS "商业保险", CASE WHEN s_nationkey % 2 = 0 THEN '中国银行佛山支行' ELSE '0' END AS "银行名称", CASE WHEN s_nationkey % 3 = 0 THEN '广州' WHEN s_nationkey % 2 = 0 THEN '佛山' ELSE '0' END AS "银行所属地" FROM supplier""")
def constants(spark, d):
    """Fixed values and defaults."""
    n = F.col("s_nationkey")
    bank, place = F.when(n % 2 == 0, "中国银行佛山支行").otherwise(""), F.when(n % 3 == 0, "广州").otherwise("")
    rows = _t(spark, d, "supplier").select("s_suppkey", F.lit("9").alias("个税金额"), F.lit("").alias("商业保险"), bank.alias("银行名称"), place.alias("银行所属地"))
    return X.fill_constants(rows, ["广州", "佛山"])


@query("SELECT 0 AS source_pos, o_orderkey AS row_idx FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def union_sources(spark, d):
    """Sources in order."""
    parts = [_t(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.lit(i).alias("source_pos"), F.col("o_orderkey").alias("row_idx")) for i, s in enumerate("OFP")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """WITH t AS (SELECT c_custkey AS row_idx, c_custkey % 6 AS m FROM customer)
SELECT row_idx, 0 AS col_idx, 'phone' AS issue, CASE WHEN m = 2 THEN '13800138000' END AS fix FROM t WHERE m IN (2, 3)
UNION ALL SELECT row_idx, 1, 'amount', NULL FROM t WHERE m = 4
UNION ALL SELECT row_idx, 2, 'form', NULL FROM t WHERE m = 5"""
)
def validate_issues(spark, d):
    """P10: one row per number that breaks its column's rule; text, and spaces within ids, phones and cards, break none."""
    m = F.col("c_custkey") % 6
    phone = F.when(m == 0, "无").when(m == 1, "138 0013 8000").when(m == 2, "138OO138OOO").when(m == 3, "12345").otherwise("13800138000")
    cells = F.array(phone, F.when(m == 4, "12.345").otherwise("1,234.5"), F.when(m == 5, "123456").otherwise("无"))
    rows = _t(spark, d, "customer").select(F.lit("s").alias("source_id"), F.col("c_custkey").alias("row_idx"), cells.alias("cells"))
    return V.cell_issues(rows, {"phone": 0, "amount": 1, "idCard": 2}).select("row_idx", "col_idx", "issue", "fix")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' || '2024' ELSE c_mktsegment END AS note FROM customer")
def remark_apply(spark, d):
    """A remark appended to selected rows."""
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("note"))
    return X.apply_remark(c, "note", F.col("c_custkey") % 3 == 0, F.lit("2024"), True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'patched ' || c_custkey ELSE c_name END AS c_name FROM customer")
def point_update(spark, d):
    """Cells from a patch table."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    patches = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("patched "), _text("c_custkey")).alias("value"))
    return X.patch_cells(c, patches, ["c_custkey"], "c_name")


@query("SELECT event_type, round(avg(value), 1) AS mean FROM events GROUP BY event_type")
def mean_conf(spark, d):
    """Means to one decimal."""
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("mean"))


@query("SELECT least(max(length(p_name)) + 2, 30) AS p_name, least(max(length(p_type)) + 2, 30) AS p_type FROM part")
def col_width(spark, d):
    """Widths by the longest text."""
    return X.column_widths(_t(spark, d, "part"), ["p_name", "p_type"])


@query("WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, v AS median FROM r WHERE k = n // 2 + 1")
def median_upper(spark, d):
    """The upper of the two middle values."""
    return P.upper_median(_t(spark, d, "part"), ["p_brand"], "p_retailprice")


@query("""SELECT p_partkey, '"' || p_name || ', ' || p_type || '",' || p_size AS line FROM part""")
def csv_lines(spark, d):
    """K1: quoted where needed."""
    p = _t(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type").alias("a"), _text("p_size").alias("b"))
    return p.select("p_partkey", X.csv_line(["a", "b"]).alias("line"))


@query(
    """WITH r AS (SELECT c_mktsegment AS g, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS BIGINT) AS n, c_name, c_acctbal FROM customer),
f AS (SELECT *, g || CASE WHEN n >= 40 THEN '_' || (n // 40 + 1) ELSE '' END || '.xlsx' AS file FROM r), p AS (SELECT DISTINCT file FROM f)
SELECT file, 0 AS sheet_no, 'Sheet1' AS sheet, n % 40 + 4 AS row_no, c_name || '|' || c_acctbal::DECIMAL(18, 2)::VARCHAR AS line FROM f
UNION ALL SELECT file, 0, 'Sheet1', k, CASE k WHEN 1 THEN '商户批次号（非必填）' WHEN 2 THEN 'B7' ELSE '收款人姓名（必填）|付款金额（元，必填）' END FROM p, (VALUES (1), (2), (3)) v(k)"""
)
def workbook_rows(spark, d):
    """K3, K6, K7: the sheets of a payment workbook per group, in parts of bounded size (the note of the first row left out)."""
    headers = ["收款人姓名（必填）", "付款金额（元，必填）"]
    rows = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias(headers[0]), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias(headers[1]))
    out = B.sheet_rows(rows, headers, B.template_book("shenbianyun", headers, "B7"), F.col("c_mktsegment"), ["c_custkey"], part_rows=40)
    return out.where("row_no > 0").select("file", "sheet_no", "sheet", "row_no", F.array_join("cells", "|").alias("line"))


@query("SELECT o_orderstatus AS source_id, 0 AS header_row, 0 AS filtered_count, count(*) AS data_rows, 'name,phone,,amount,note' AS types FROM orders GROUP BY o_orderstatus")
def detect_sheet(spark, d):
    """Table detection and typing of three sheets, end to end."""
    body = _people(spark, d).withColumn("row_idx", F.col("row_idx") + 1)
    phone = F.concat(F.lit("13"), F.lpad(F.get("cells", F.lit(1)), 9, "0"))
    body = body.select("source_id", "row_idx", F.array(F.lit("王辉"), phone, F.lit("x"), F.get("cells", F.lit(3)), F.lit("")).alias("cells"))
    heads = body.select("source_id").distinct().select("source_id", F.lit(0).cast("long").alias("row_idx"), F.array(*map(F.lit, ("姓名", "手机", "级别", "金额", "备注"))).alias("cells"))
    tables, rows, columns = D.detect_columns(heads.unionByName(body))
    types = columns.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "type"))), lambda s: s["type"]), ",").alias("types"))
    n = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("data_rows"))
    return tables.select("source_id", "header_row", "filtered_count").join(n, "source_id").join(types, "source_id")


# --- clients of a batch, direct tables, imports -----------------------------------


def _nation_clients(spark, d):
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").select(k.alias("pos"), k.cast("string").alias("id"), F.col("n_name").alias("full_name"), F.concat(F.lit("S"), k).alias("short_name"), F.concat(F.lit("T"), k % 20).alias("tax_id"))


def _batches(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return _t(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 7 == 0, F.concat(F.lit(" "), n)).when(k % 7 == 1, "999").otherwise("").alias("mapped_id"),
        F.when(k % 2 == 0, F.concat(F.lit("NATION_"), n)).otherwise("").alias("client_name"),
        F.when(k % 3 == 0, F.concat(F.lit("t"), n)).otherwise("").alias("tax_id"),
    )


_CLIENT_SQL = """WITH c AS (SELECT n_nationkey AS pos, CAST(n_nationkey AS VARCHAR) AS id, n_name AS full_name, 'S' || n_nationkey AS short, 'T' || (n_nationkey % 20) AS tax FROM nation),
r AS (SELECT a.id, arg_min(b.id, b.pos) AS rid FROM c a JOIN c b ON a.full_name = b.full_name OR a.short = b.short OR a.tax = b.tax GROUP BY a.id),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_custkey % 7 = 1 THEN '999' ELSE '' END AS mapped,
        CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || c_nationkey ELSE '' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'T' || c_nationkey ELSE '' END AS tax FROM customer),
t AS (SELECT tax, arg_min(id, pos) AS tid, arg_min(short, pos) AS tshort FROM c GROUP BY tax),
n AS (SELECT name, count(*) AS n, min(rid) AS one, string_agg(c.id || ' - ' || short || '/' || CASE WHEN full_name = name THEN '全称精确' ELSE '模糊匹配' END, ',' ORDER BY CASE WHEN full_name = name THEN 0 ELSE 1 END, pos) AS shown
      FROM (SELECT DISTINCT name FROM b WHERE name <> '') JOIN c ON contains(full_name, name) OR contains(name, full_name) JOIN r USING (id) GROUP BY name),
x AS (SELECT b.c_custkey, c.id, tr.rid, t.tshort, n.n, n.one, n.shown FROM b LEFT JOIN c ON c.id = b.mapped LEFT JOIN t ON t.tax = b.tax LEFT JOIN r tr ON tr.id = t.tid LEFT JOIN n ON n.name = b.name)
"""


def _listed(candidates: str) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws("/", c["label"], c["match_type"])), ",").alias("candidates")


@query(
    """WITH n AS (SELECT n_nationkey AS pos, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE 'T' || n_nationkey END AS tax, 'R' || n_regionkey AS short, n_name FROM nation),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || c_nationkey ELSE 'x' END AS f, CASE WHEN c_custkey % 11 = 0 THEN 'R4' ELSE 'y' END AS s, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'T' || (c_custkey % 30) END AS t FROM customer)
SELECT c_custkey, CAST(min(pos) AS VARCHAR) AS client_id FROM r LEFT JOIN n ON n_name = f OR short = s OR tax = t GROUP BY c_custkey"""
)
def reverse_lookup(spark, d):
    """The first client with the same full name, short name or tax id, empty ones included."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    clients = _t(spark, d, "nation").select(n.alias("pos"), n.cast("string").alias("id"), F.col("n_name").alias("full_name"), F.concat(F.lit("R"), "n_regionkey").alias("short_name"), F.when(n % 4 != 3, F.concat(F.lit("T"), n)).alias("tax_id"))
    full, short = F.when(k % 2 == 0, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise("x"), F.when(k % 11 == 0, "R4").otherwise("y")
    rows = _t(spark, d, "customer").select("c_custkey", full.alias("full_name"), short.alias("short_name"), F.when(k % 5 != 0, F.concat(F.lit("T"), k % 30)).otherwise("").alias("tax_id"))
    return M.reverse_lookup(rows, clients).select("c_custkey", "client_id")


@query(
    _CLIENT_SQL
    + """SELECT c_custkey, coalesce(id, rid, CASE WHEN n = 1 THEN one END) AS client_id, CASE WHEN id IS NOT NULL THEN 'id' WHEN rid IS NOT NULL THEN 'tax' WHEN n = 1 THEN 'name' END AS matched_by,
CASE WHEN id IS NULL AND rid IS NULL AND n > 1 THEN shown ELSE '' END AS candidates FROM x"""
)
def best_client(spark, d):
    """Id, then tax id, then a name of one client; several are candidates only."""
    return M.best_client(_batches(spark, d), _nation_clients(spark, d)).select("c_custkey", "client_id", "matched_by", _listed("candidates"))


@query(_CLIENT_SQL + "SELECT c_custkey, CASE WHEN rid IS NOT NULL THEN rid || ' - ' || tshort || '/税号精确' ELSE coalesce(shown, '') END AS candidates FROM x")
def client_candidates(spark, d):
    """The client of the tax id, else all that the name fits."""
    return M.client_candidates(_batches(spark, d), _nation_clients(spark, d)).select("c_custkey", _listed("candidates"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE '' END AS content FROM orders")
def task_content(spark, d):
    """The first task of a trimmed name."""
    task = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("content"))
    tasks = F.array(task("甲 ", F.concat(F.lit(" "), "o_orderstatus")), task("乙", F.col("o_orderpriority")), task("甲", F.lit("later")), task("丙", F.lit(None).cast("string")))
    name = F.get(F.array(*map(F.lit, (" 甲", "乙", "丙", ""))), (F.col("o_orderkey") % 4).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", M.task_content(tasks, name).alias("content"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'C9' ELSE CAST(s_nationkey AS VARCHAR) END AS client, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN '平台' ELSE '' END AS platform, false AS unmatched FROM supplier"""
)
def manual_client(spark, d):
    """A client chosen by hand, on unmatched rows only."""
    k = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select("s_suppkey", _text("s_nationkey").alias("client"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("platform"), (k % 3 == 0).alias("unmatched"))
    return M.manual_client(rows, "unmatched", "client", "C9", {"platform": F.lit("平台")})


@query("SELECT count(*) FILTER (n_nationkey IS NOT NULL) AS matched, count(*) AS total FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def match_statistic(spark, d):
    """Rows with a client, and all rows."""
    clients = _t(spark, d, "nation").where("n_regionkey <> 2").select(_text("n_nationkey").alias("id"), _text("n_nationkey").alias("client"))
    return M.match_statistic(R.lookup_id(_t(spark, d, "customer").withColumn("key", _text("c_nationkey")), "key", clients), "client")


@query("SELECT count(DISTINCT c_custkey) AS clients, count(o_orderkey) AS tasks FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def reference_status(spark, d):
    """Clients and their tasks."""
    tasks = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("tasks"))
    return M.reference_status(_t(spark, d, "customer").join(tasks, F.col("c_custkey") == F.col("o_custkey"), "left"))


@query("SELECT c_custkey AS row_idx, '姓名|列3|金额' AS headers, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '王辉' END || '|' || ' x' || '|' || c_acctbal::DECIMAL(18, 2)::VARCHAR AS line FROM customer")
def raw_direct(spark, d):
    """Recognised columns as they are, names cleaned."""
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("王辉"), F.col("c_custkey") % 4))
    rows = _t(spark, d, "customer").select(F.lit("s").alias("source_id"), F.col("c_custkey").alias("row_idx"), F.array(name, F.lit("no"), F.lit(" x"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("cells"))
    headers, out = T.raw_table(rows, {3: "金额", 0: " 姓名 ", 2: ""}, 0)
    return out.select("row_idx", F.lit("|".join(headers)).alias("headers"), F.array_join("cells", "|").alias("line"))


@query(
    """WITH t AS (SELECT o_orderkey AS row_idx, o_orderkey % 5 AS a, o_custkey % 3 AS b FROM orders),
s AS (SELECT row_idx, 0 AS split_idx, CAST(a AS VARCHAR) AS v, '工资' AS label FROM t WHERE a <> 0 UNION ALL SELECT row_idx, 1, CAST(b AS VARCHAR), '第 3 列' FROM t WHERE b <> 0
UNION ALL SELECT row_idx, 0, '0', '' FROM t WHERE a = 0 AND b = 0)
SELECT row_idx, split_idx, '姓名|税前金额|手机号|手机号2|备注' AS headers, '王辉|' || v || '|13800138000|1|' || label AS line FROM s"""
)
def mapped_direct(spark, d):
    """Typed columns under standard headers, amounts split and labelled, the total left out."""
    a, b = F.col("o_orderkey") % 5, F.col("o_custkey") % 3
    cells = F.array(F.lit("王辉2"), a.cast("string"), b.cast("string"), F.lit(" 138 0013 8000"), F.lit("不识别"), (a + b).cast("string"), F.lit("1"))
    rows = _t(spark, d, "orders").select(F.lit("s").alias("source_id"), F.col("o_orderkey").alias("row_idx"), cells.alias("cells"))
    headers, out, _ = T.mapped_table(rows, {0: "name", 1: "amount", 2: "amount", 3: "phone", 4: "", 5: "amountTotal", 6: "phone"}, {1: "工资", 2: " "}, 0, True)
    return out.select("row_idx", "split_idx", F.lit("|".join(headers)).alias("headers"), F.array_join("cells", "|").alias("line"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey AS k, '20' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS y, CAST(o_orderkey % 12 + 1 AS VARCHAR) AS m FROM orders WHERE o_orderkey % 30 < 20)
SELECT CAST(o_custkey AS VARCHAR) AS source_id, coalesce(arg_min(y, k) FILTER (k % 3 <> 1), '') AS year_hint, coalesce(arg_min(y || CASE k % 3 WHEN 0 THEN '年 ' || m || '月' ELSE '-' || m END, k) FILTER (k % 3 <> 1), '') AS month_hint FROM o GROUP BY o_custkey"""
)
def date_hints(spark, d):
    """The first year and month in the leading rows."""
    k = F.col("o_orderkey")
    year, month = F.concat(F.lit("20"), F.lpad((k % 100).cast("string"), 2, "0")), (k % 12 + 1).cast("string")
    cell = F.when(k % 3 == 0, F.concat(F.lit("报表"), year, F.lit("年 "), month, F.lit("月"))).when(k % 3 == 2, F.concat(F.lit("期间 "), year, F.lit("-"), month)).otherwise("x")
    return T.date_hints(_t(spark, d, "orders").select(_text("o_custkey").alias("source_id"), k.alias("sheet_idx"), (k % 30).alias("row_idx"), F.array(F.lit("x"), cell).alias("cells")))


@query("SELECT s_suppkey, 'f' || s_nationkey || ' / ' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '默认表' END AS label FROM supplier")
def group_label(spark, d):
    """F18."""
    sheet = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("")
    return _t(spark, d, "supplier").select("s_suppkey", T.group_label(F.concat(F.lit("f"), "s_nationkey"), sheet, True).alias("label"))


@query("SELECT p_partkey, replace(p_name, ' ', '/') || '/' || p_brand AS words FROM part")
def split_keywords(spark, d):
    """Half- and full-width commas."""
    return _t(spark, d, "part").select("p_partkey", F.array_join(I.split_keywords(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ,")), F.lit("，, "), "p_brand")), "/").alias("words"))


@query(
    """WITH o AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'platform' ELSE 'tax_source' END AS kind, n_name AS key, n_name AS value, n_nationkey AS pos FROM nation),
p AS (SELECT 'tax_source' AS kind, 'NATION_' || (s_suppkey % 40) AS key, arg_max(s_name, s_suppkey) AS value, min(s_suppkey) AS pos FROM supplier GROUP BY ALL)
SELECT kind, key, coalesce(p.value, o.value) AS value, CAST(coalesce(o.pos, p.pos + (SELECT max(pos) + 1 FROM o)) AS BIGINT) AS pos, o.pos IS NULL AS added FROM o FULL JOIN p USING (kind, key)"""
)
def merge_config(spark, d):
    """A patch of the configuration."""
    old = _t(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "platform").otherwise("tax_source").alias("kind"), F.col("n_name").alias("key"), F.array("n_name").alias("value"), F.col("n_nationkey").alias("pos"))
    patch = _t(spark, d, "supplier").select(F.lit("tax_source").alias("kind"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 40).alias("key"), F.array("s_name").alias("value"), F.col("s_suppkey").alias("pos"))
    return I.merge_config(old, patch).withColumn("value", F.array_join("value", ","))


@query(
    """WITH o AS (SELECT c_nationkey || '|' || c_mktsegment AS key, arg_max(c_custkey || '.' || c_mktsegment || '(' || c_nationkey || ')', c_custkey) AS entry, min(c_custkey) AS pos FROM customer GROUP BY 1),
n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_nationkey || '|BUILDING' END AS key, arg_max(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '7' || s_suppkey || '.BUILDING(' || s_nationkey || ')' END, s_suppkey) AS entry, min(s_suppkey) AS pos FROM supplier GROUP BY 1)
SELECT key, coalesce(n.entry, o.entry) AS entry, CAST(coalesce(o.pos, n.pos + (SELECT max(c_custkey) + 1 FROM customer)) AS BIGINT) AS pos, o.pos IS NULL AS added FROM o FULL JOIN n USING (key)"""
)
def merge_tasks(spark, d):
    """Task list entries by client and task name."""
    entry = lambda seq, name, i: F.concat(seq, F.lit("."), name, F.lit("("), i, F.lit(")"))
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), entry("c_custkey", "c_mktsegment", "c_nationkey").alias("entry"))
    new = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(entry(F.concat(F.lit("7"), "s_suppkey"), F.lit("BUILDING"), "s_nationkey")).alias("entry"))
    return I.merge_tasks(old, new)


@query(
    """WITH o AS (SELECT n_nationkey AS id, n_name AS full_name FROM nation), n AS (SELECT n_nationkey + 10 AS id, 'S' || n_nationkey AS short_name, n_nationkey AS pos FROM nation)
SELECT CAST(coalesce(o.id, n.id) AS VARCHAR) AS id, CASE WHEN n.id IS NULL THEN full_name END AS full_name, short_name, CAST(coalesce(o.id, n.pos + (SELECT max(id) + 1 FROM o)) AS BIGINT) AS pos, o.id IS NULL AS added FROM o FULL JOIN n ON o.id = n.id"""
)
def import_clients(spark, d):
    """Imported clients replace old ones whole."""
    k, nation = F.col("n_nationkey"), _t(spark, d, "nation")
    return I.import_clients(nation.select(k.cast("string").alias("id"), k.alias("pos"), F.col("n_name").alias("full_name")), nation.select((k + 10).cast("string").alias("id"), k.alias("pos"), F.concat(F.lit("S"), k).alias("short_name")))


@query(
    """WITH s AS (SELECT s_suppkey + 1 AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS t, 'P' || s_nationkey AS p, 'E' || s_nationkey AS e, s_suppkey % 3 = 0 AS y FROM supplier)
SELECT 'tax_source' AS kind, t AS key, t AS value, pos FROM s WHERE t <> ''
UNION ALL SELECT 'platform', p, p, min(pos) FROM s GROUP BY p
UNION ALL SELECT 'sign_entity', e, arg_max(p || '/b', pos), min(pos) FROM s WHERE y GROUP BY e
UNION ALL SELECT 'platform_tax', p, arg_max(t, pos), min(pos) FROM s WHERE t <> '' GROUP BY p"""
)
def config_sheet(spark, d):
    """Lists and mappings of a configuration sheet."""
    k = F.col("s_suppkey")
    tax, platform = F.when(k % 2 == 0, F.col("s_name")).otherwise(""), F.concat(F.lit("P"), "s_nationkey")
    entity = F.concat(F.lit("E"), "s_nationkey", F.when(k % 3 == 0, F.lit(" → ")).otherwise("-"), platform, F.lit("，b,"))
    body = _t(spark, d, "supplier").select((k + 1).alias("row_idx"), F.array(tax, F.concat(F.lit(" "), platform), entity, F.concat(platform, F.lit("→"), tax)).alias("cells"))
    head = spark.createDataFrame([(0, ["税源地", "平台", "签约主体", "平台税源地"])], "row_idx long, cells array<string>")
    return I.config_sheet(head.unionByName(body).withColumn("source_id", F.lit("s"))).withColumn("value", F.array_join("value", "/"))


@query(
    """WITH r AS (SELECT c_custkey, c_name, c_acctbal::DECIMAL(18, 2)::VARCHAR AS a, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT 'yidao' AS template, c_mktsegment AS source_id, c_custkey AS row_idx, c_name || '||||' || '|' || a AS line FROM r
UNION ALL SELECT 'shenbianyun', c_mktsegment, c_custkey, '||' || c_name || '|||' || a || '|||' FROM r
UNION ALL SELECT 'youyi', c_mktsegment, c_custkey, '|||' || c_name || '||||||||0|0|' || a || '|0|0|' FROM r"""
)
def fan_out(spark, d):
    """Three templates from one scan of the chosen sources."""
    c = _t(spark, d, "customer")
    rows = c.select(F.col("c_mktsegment").alias("source_id"), F.col("c_custkey").alias("row_idx"), F.array(F.col("c_name"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("cells"))
    chosen = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "source_id string")
    templates = [X.TEMPLATES[k] for k in ("yidao", "shenbianyun", "youyi")]
    out = X.fan_out(rows, {"name": 0, "amount": 1}, templates, chosen)
    # The amount's own place, since an amount of zero is written like the constants of other columns.
    place = F.coalesce(*[F.when(F.col("template") == t.name, t.headers.index(dict(t.fields)["amount"])) for t in templates])
    full = lambda v, i: F.when(i == place, F.coalesce(v.try_cast("decimal(18,2)").cast("string"), v)).otherwise(v)
    return out.select("template", "source_id", "row_idx", F.array_join(F.transform("cells", full), "|").alias("line"))


@query(
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS doc, c_name AS id, c_mktsegment AS short_name, c_acctbal::DECIMAL(18, 2)::DOUBLE AS fee_rate, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS pos FROM customer)
SELECT doc, pos, id, short_name, fee_rate, 1 AS version FROM c"""
)
def document_clients(spark, d):
    """Documents of an older version loaded, brought up to date and split into clients, in the order of the text."""
    c = _t(spark, d, "customer")
    entry = F.struct(-F.col("c_custkey"), F.col("c_name").alias("id"), F.struct(F.col("c_mktsegment").alias("shortName"), F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("%")).alias("feeRate")).alias("v"))
    people = F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["id"], e["v"])))
    docs = c.groupBy(_text("c_nationkey").alias("doc")).agg(F.to_json(F.struct(people.alias("shangSheMap"))).alias("value"))
    loaded = RD.load_documents(docs)
    return RD.clients_of(loaded).join(loaded.select("doc", F.col("document.schemaVersion").alias("version")), "doc").select("doc", "pos", "id", "short_name", "fee_rate", "version")


@query("SELECT o_custkey AS owner, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 AS accepted FROM orders")
def edit_lists(spark, d):
    """Additions to each owner's task list, repeated ones rejected."""
    o = _t(spark, d, "orders")
    none = F.lit(None)
    log = o.select(F.col("o_custkey").alias("owner"), F.lit("task").alias("kind"), F.col("o_orderkey").alias("seq"), F.lit("add").alias("op"), none.cast("int").alias("at"), none.cast("string").alias("target"), F.concat(F.lit(" "), "o_orderpriority").alias("key"), none.cast("array<string>").alias("value"))
    had = spark.createDataFrame([], "owner long, kind string, pos long, key string, value array<string>")
    return L.replay_lists(had, log)[1].select("owner", "seq", "accepted")


@query(
    """WITH w AS (SELECT c_custkey AS row_no, max_by(o_orderkey % 3 = 0, o_orderkey) AS own, max(o_orderkey) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 < 2 GROUP BY c_custkey),
f AS (SELECT max(o_orderkey) AS seq FROM orders WHERE o_orderkey % 3 = 2)
SELECT row_no, CASE WHEN newest > seq THEN own ELSE c_mktsegment = 'BUILDING' END AS selected FROM w JOIN customer ON c_custkey = row_no CROSS JOIN f"""
)
def edit_selection(spark, d):
    """Single rows selected and let go, and a file's rows chosen, in the order of the log."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    single = o.where(k % 3 < 2).select(k.alias("seq"), F.when(k % 3 == 0, "row").otherwise("unrow").alias("op"), F.col("o_custkey").alias("n"), F.lit(None).cast("string").alias("file"))
    wide = o.where(k % 3 == 2).agg(F.max(k).alias("seq")).select("seq", F.lit("file").alias("op"), F.lit(None).cast("long").alias("n"), F.lit("BUILDING").alias("file"))
    return L.replay_selection(_t(spark, d, "customer").select(F.col("c_custkey").alias("row_no"), F.col("c_mktsegment").alias("_file")), single.unionByName(wide)).select("row_no", "selected")


@query(
    """WITH l AS (SELECT o_orderkey AS seq, o_custkey AS k, o_orderkey % 2 = 0 AS p, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus WHEN o_orderkey % 4 = 0 THEN '294.湖南清源' ELSE 'nowhere' END AS v FROM orders),
p AS (SELECT k, arg_max(v, seq) AS v FROM l WHERE p GROUP BY k), t AS (SELECT k, arg_max(CASE WHEN p THEN '0001.湖南' ELSE v END, seq) AS v FROM l WHERE NOT p OR v <> 'nowhere' GROUP BY k)
SELECT c_custkey, coalesce(p.v, 'P') AS platform, coalesce(t.v, 'T') AS tax_source FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN t ON t.k = c_custkey"""
)
def edit_cells(spark, d):
    """Platforms and tax sources edited by turns; a platform takes its tax source along."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    value = F.when(k % 2 == 1, F.col("o_orderstatus")).when(k % 4 == 0, "294.湖南清源").otherwise("nowhere")
    log = _t(spark, d, "orders").select(k.alias("seq"), F.col("o_custkey").alias("row_no"), F.when(k % 2 == 0, "platform").otherwise("tax").alias("field"), value.alias("value"))
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("row_no"), none.alias(E.CLIENT), F.lit("P").alias(E.PLATFORM), F.lit("T").alias(E.TAX), F.lit("").alias(E.TASK), F.lit("").alias(E.WORK))
    out = L.replay_cells(rows, log, E.tasks_of_clients(_payout_clients(spark, d)))
    return out.select("c_custkey", F.col(E.PLATFORM).alias("platform"), F.col(E.TAX).alias("tax_source"))


@query(
    """WITH w AS (SELECT CAST(user_id % 40 AS VARCHAR) AS s, event_id AS k, event_type AS t, (event_id * 37) % 600 + 0.5 AS x, 5 + event_id % 20 AS w, (event_id * 31) % 997 * 3 AS y FROM events),
l AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY y, x, t ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY s ORDER BY y, x, t) > 6 THEN 1 ELSE 0 END AS n FROM w)),
b(r, x0, x1) AS (VALUES (0, 0, 150), (1, 150, 300), (2, 300, 520)),
o AS (SELECT s, k, arg_min(r, CASE WHEN v > 0 THEN -v ELSE 1000 + abs(x + w / 2.0 - (x0 + x1) / 2.0) END + r * 1e-9) AS r FROM (SELECT *, least(x + w, x1) - greatest(x, x0) AS v FROM l CROSS JOIN b) GROUP BY s, k),
g AS (SELECT *, sum(n2) OVER (PARTITION BY s, line, r ORDER BY x, y, t ROWS UNBOUNDED PRECEDING) AS sub FROM (SELECT l.*, o.r, CASE WHEN l.x - lag(l.x + l.w) OVER (PARTITION BY l.s, line, o.r ORDER BY l.x, y, t) > 6 THEN 1 ELSE 0 END AS n2 FROM l JOIN o USING (s, k)))
SELECT s AS source_id, line AS row_idx, count(*) AS cells, max(c) AS text FROM (SELECT s, line, r, sub, string_agg(t, ' ' ORDER BY x, y, t) AS c FROM g GROUP BY s, line, r, sub) GROUP BY s, line"""
)
def words_in_borders(spark, d):
    """Words to regions and sub-cells; per row, the filled cells and the greatest text."""
    k = F.col("event_id")
    e = _t(spark, d, "events").select((F.col("user_id") % 40).cast("string").alias("source_id"), F.col("event_type").alias("text"), ((k * 37) % 600 + 0.5).alias("x"), ((k * 31) % 997 * 3).cast("double").alias("y"), (5 + k % 20).cast("double").alias("w"), F.lit(8.0).alias("h"))
    lines = e.select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, (0, 150, 300, 520)))).alias("x"))
    filled = F.filter("cells", lambda c: c != "")
    return W.words_in_borders(e, lines).select("source_id", "row_idx", F.size(filled).cast("long").alias("cells"), F.array_max(filled).alias("text"))


RUN_DATE = datetime.date(2024, 1, 31)


@query(
    """WITH r AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS s, o_orderpriority AS t FROM orders),
f AS (SELECT k, coalesce(arg_max(s, i) FILTER (s <> ''), '') AS s, min(i) AS i, list(t ORDER BY i) AS ts FROM r GROUP BY k),
o AS (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(f.k, o.k)::VARCHAR AS id, CASE WHEN f.s <> '' THEN f.s ELSE coalesce(n, '') END AS short_name, o.k IS NULL AS added,
coalesce((SELECT string_agg(x, '|' ORDER BY a) FROM (SELECT t AS x, min(i) AS a FROM r WHERE r.k = f.k GROUP BY t)), '') AS tasks FROM f FULL JOIN o ON o.k = f.k"""
)
def upsert_clients(spark, d):
    """Client sheets merged into the client table: latest values, tasks once each, new and old clients."""
    c, o, k = _t(spark, d, "customer"), _t(spark, d, "orders"), F.col("o_orderkey")
    empty = F.lit("")
    old = c.where("c_custkey % 2 = 0").select(_text("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("short_name"), *[empty.alias(x) for x in ("full_name", "tax_id", "sign_entity")], F.lit(1.5).alias("fee_rate"), F.array().cast("array<struct<name:string,content:string>>").alias("tasks"))
    rows = o.select(k.alias("row_idx"), _text("o_custkey").alias("id"), F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("short_name"), *[empty.alias(x) for x in ("full_name", "tax_id", "fee_rate", "sign_entity")], F.col("o_orderpriority").alias("task_name"), empty.alias("task_content"))
    out, _ = I.upsert_clients(old, rows)
    return out.select("id", "short_name", "added", F.array_join(F.transform("tasks", lambda t: t["name"]), "|").alias("tasks"))


@query("SELECT c_custkey, '20240131' || 'WH' || '-A' AS batch_no FROM customer")
def batch_number(spark, d):
    """Run date, initials and -A."""
    return _t(spark, d, "customer").select("c_custkey", S.batch_number(F.concat(F.lit("甲-王辉有限公司"), F.lit("")), F.lit(RUN_DATE)).alias("batch_no"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Detect, clean, split, reconcile and project, over the line items as a sheet."""
    rows = _sum_grid(spark, d)
    split, _ = P.split_amounts(rows, [0, 1], 2, label_note=False)
    return split.select("source_id", "row_idx", "split_idx", S.sanitize_amount(F.get("cells", F.lit(0))).alias("amount"))
