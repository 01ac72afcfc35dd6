"""Queries over the stored index, its maintenance, layouts, counters and documents, with their SQL oracles.

Tables of volumes, blocks and requests are derived from the driver's tables row by row."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..index import Index
from ..operators import codes as C
from ..operators import damage as D
from ..operators import integrity as I
from ..operators import maintenance as M
from ..operators import vectors as V
from ..sources import batches as B
from .catalog import BYTES, DS, EVERY, R, SCAN, TOP, TWO, K, _corpus, _raw, _setup, query
from .catalog import M as SUBSPACES


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root}/lodestar-index-{uuid.uuid4().hex}"


def _built(spark, sf) -> tuple[Index, DataFrame]:
    """An index of the first three quarters of the rows by id, appended to with the rest; and the queries."""
    corpus, queries, book, _ = _setup(spark, sf)
    cut = corpus.agg(F.max("vec_id")).first()[0] * 3 // 4
    index = Index.build(corpus.where(F.col("vec_id") <= cut), _folder(spark), book, R)
    return index.append(corpus.where(F.col("vec_id") > cut)), queries


@query(f"with {TWO} select qid, vec_id, score, rank from two")
def search_from_index(spark, sf):
    index, queries = _built(spark, sf)
    return index.search(queries, TOP)


@query("select vec_id, case when vec_id <= (select max(vec_id) from embeddings) then 'stored' else 'absent' end as status from range(100, (select max(vec_id) + 50 from embeddings)) r(vec_id)")
def index_round_trip(spark, sf):
    index, _ = _built(spark, sf)
    last = _raw(spark, sf).agg(F.max("vec_id")).first()[0]
    same = index.records().join(_corpus(spark, sf).withColumnRenamed("v", "w"), "vec_id").where("v <> w")
    if same.take(1) or index.verify().where("not ok").take(1):
        raise ValueError("the stored rows differ")
    return index.vectors(100, last + 50 - 100).select("vec_id", "status")


@query("with c as (select (max(vec_id) * 3 // 4)::bigint as cut, max(vec_id) as last from embeddings) select 0::bigint as sequence, cut + 1 as n, 0::bigint as first, cut as last from c union all select 1, last - cut, cut + 1, last from c")
def index_manifests(spark, sf):
    return _built(spark, sf)[0].describe().select("sequence", "n", "first", "last")


# ---- append, repair, scrub ------------------------------------------------

VOLUMES = "select o_orderkey as id, o_custkey as built, o_orderkey % 50 as appended, o_orderkey * 13 as error_sum from orders"


def _volumes(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as id", "o_custkey as built", "o_orderkey % 50 as appended", "o_orderkey * 13 as error_sum")


@query(f"with v as ({VOLUMES}) select *, (case when appended = 0 then 0 else error_sum * 1024 // appended end)::bigint as mean_error_x1024, (case when built + appended = 0 then 0 else appended * 1000000 // (built + appended) end)::bigint as appended_ppm, (case when built + appended = 0 then 0 else appended * 1000000 // (built + appended) end) > 100000 as rebuild from v")
def drift_report(spark, sf):
    return M.drift(_volumes(spark, sf), 100_000)


@query("with v as (select o_orderkey as id, o_custkey as built, o_custkey + o_orderkey % 200 as appended_from, o_custkey + o_orderkey % 200 + o_orderkey % 90 - 20 as n from orders), r as (select *, (built + 63) // 64 as hi, appended_from // 64 as lo, (n + 63) // 64 as up from v) select id, 0::bigint as from_block, (case when n > appended_from and lo <= hi then up else hi end)::bigint as to_block from r union all select id, lo, up from r where n > appended_from and lo > hi")
def written_runs(spark, sf):
    v = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as id", "o_custkey as built", "o_custkey + o_orderkey % 200 as appended_from", "o_custkey + o_orderkey % 200 + o_orderkey % 90 - 20 as n")
    return M.written_runs(v, 64)


def _with_erased(spark, sf) -> DataFrame:
    """The code blocks, and as many erased ones after them."""
    data = I.blocks(_setup(spark, sf)[3], SUBSPACES)
    return data.select("block_no", "bytes").union(data.select(F.col("block_no") + 1000, F.unhex(F.repeat(F.lit("FF"), 512))))


@query("select 1000::bigint as head, count(*)::bigint as erased, (count(*) * 64)::bigint as slots from (select distinct vec_id // 64 from embeddings)")
def append_capacity(spark, sf):
    return M.capacity(_with_erased(spark, sf), 64)


@query("with v as (select l_orderkey * 10 + l_linenumber as id, l_partkey as n, 256::bigint as centroids, l_suppkey as codebook_blocks, l_quantity::bigint as bad_payload, l_linenumber::bigint as bad_rerank, (l_orderkey % 4)::bigint as bad_codebook from lineitem) select id, least(n, bad_payload * 32)::bigint as wrong_codes, least(n, bad_rerank * 4)::bigint as will_drop, least(n, bad_codebook * ((256 + greatest(1, codebook_blocks) - 1) // greatest(1, codebook_blocks)) * n // 256)::bigint as misread from v")
def verify_consequences(spark, sf):
    v = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_partkey as n", "256L as centroids", "16 as m", "128 as d", "l_suppkey as codebook_blocks", "cast(l_quantity as long) as bad_payload", "cast(l_linenumber as long) as bad_rerank", "l_orderkey % 4 as bad_codebook")
    return M.consequences(v).select("id", "wrong_codes", "will_drop", "misread")


#: Copies of each code block; copy k of block b is damaged if (b + k) leaves no rest by k + 2.
COPIES = "select b.b as block_no, k.k, (b.b + k.k) % (k.k + 2) = 0 as bad from range((select max(vec_id) // 64 + 1 from embeddings)) b(b) cross join range(3) k(k)"


def _copies(spark, sf) -> DataFrame:
    data = I.blocks(_setup(spark, sf)[3], SUBSPACES)
    copies = data.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    bad = (F.col("block_no") + F.col("copy")) % (F.col("copy") + 2) == 0
    return copies.withColumn("bytes", F.when(bad, F.unhex(F.repeat(F.lit("00"), 512))).otherwise(F.col("bytes")))


@query(f"with c as ({COPIES}), f as (select block_no, min(case when not bad then k end)::int as k from c group by 1) select block_no::bigint as block_no, case when k = 0 then 'clean' when k is null then 'unrepairable' else 'repaired' end as outcome, case when k > 0 then k end as from_copy from f")
def repair_report(spark, sf):
    return M.repair(_copies(spark, sf))


@query(f"with c as ({COPIES}), f as (select block_no, min(case when not bad then k end)::int as k from c group by 1) select count(*)::bigint as examined, count_if(k = 0)::bigint as clean, count_if(k > 0)::bigint as repaired, count_if(k is null)::bigint as dropped, count_if(k > 0)::bigint as erases from f")
def repair_totals(spark, sf):
    return M.repair_totals(M.repair(_copies(spark, sf)))


@query(f"with c as ({COPIES}) select ('copy ' || k) as region, count_if(block_no >= 2 and block_no < 6)::bigint as verified, count_if(block_no >= 2 and block_no < 6 and bad)::bigint as failed, (case when max(block_no) + 1 <= 6 then 0 else 6 end)::bigint as cursor, max(block_no) + 1 <= 6 as completed from c group by k")
def scrub_cursor(spark, sf):
    return M.scrub(_copies(spark, sf).withColumn("region", F.concat(F.lit("copy "), F.col("copy").cast("string"))), 2, 4)


@query("with r as (select n_regionkey as volume, n_nationkey as place, ['payload', 'rerank', 'codebook', 'payload_crc', 'codebook_replica', 'rerank_crc'][(n_nationkey % 6 + 1)::int] as kind from nation), p as (select *, (case when kind like 'codebook%' then 0 when kind like 'payload%' then 1 else 2 end)::int as priority from r) select *, row_number() over (partition by volume order by priority, place)::int as turn from p")
def region_priority(spark, sf):
    kinds = "array('payload', 'rerank', 'codebook', 'payload_crc', 'codebook_replica', 'rerank_crc')[int(n_nationkey % 6)]"
    return M.by_priority(spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_regionkey as volume", "n_nationkey as place", f"{kinds} as kind"))


@query("with r as (select p_partkey, (p_partkey * 1024 % 40960)::bigint as base, [0, 256, 512, 500][(p_partkey % 4 + 1)::int]::bigint as block_bytes, (p_size * 4)::bigint as blocks from part) select *, case when base % 4096 <> 0 then 'unaligned' when block_bytes = 0 or 4096 % block_bytes <> 0 then 'block size' when blocks * block_bytes % 4096 <> 0 then 'extent' when base + blocks * block_bytes > 4294967295 then 'overflow' end as refused from r")
def region_valid(spark, sf):
    return M.region_valid(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "p_partkey * 1024 % 40960 as base", "array(0L, 256L, 512L, 500L)[int(p_partkey % 4)] as block_bytes", "cast(p_size * 4 as long) as blocks"))


GROUPS = "select s_suppkey as volume, g.g, (g.g * 64 - case when s_suppkey % 3 = 0 and g.g = 2 then 1 else 0 end)::bigint as first, (64 - case when s_suppkey % 5 = 0 and g.g = 3 then 64 else 0 end)::bigint as centroids, (2 + case when s_suppkey % 7 = 0 then 1 else 0 end)::bigint as units from supplier cross join range(4) g(g)"


@query(f"with g as ({GROUPS}), a as (select *, lag(first + centroids, 1, 0) over (partition by volume order by g) as ahead from g) select volume, bool_and(first = ahead and centroids > 0 and units = (centroids * 128 + 4095) // 4096) and count(*) between 4 and 8 and max(first + centroids) = 256 as valid from a group by 1")
def group_tables(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("g"))
    return M.groups_valid(s.selectExpr("s_suppkey as volume", "g", "g * 64 - if(s_suppkey % 3 = 0 and g = 2, 1, 0) as first", "64 - if(s_suppkey % 5 = 0 and g = 3, 64, 0) as centroids", "2 + if(s_suppkey % 7 = 0, 1, 0) as units"), 256, 128)


# ---- layouts, counters, documents -----------------------------------------


@query("with p as (select p_partkey as n, [16, 32, 8][(p_partkey % 3 + 1)::int]::int as m, [8, 4][(p_partkey % 2 + 1)::int]::int as b, [128, 768][(p_size % 2 + 1)::int]::int as d, 2::int as copies from part), a as (select *, (m * b // 8)::bigint as payload_bytes, ((1 << b) * d)::bigint as codebook_bytes, (512 // (m * b // 8))::bigint as per_block, greatest(1, 512 // d)::bigint as records_per_block, (d + 511) // 512 as bpr from p), z as (select *, (n + per_block - 1) // per_block as payload_blocks, ((n + records_per_block - 1) // records_per_block * bpr) as rerank_blocks from a) select n, m, b, d, payload_bytes, codebook_bytes, per_block, payload_blocks::bigint as payload_blocks, rerank_blocks::bigint as rerank_blocks, ((payload_blocks * 512 + 4095) // 4096 * 4096)::bigint as payload_region, ((codebook_bytes + 4095) // 4096 * 4096)::bigint as replica_region, ((payload_bytes + d) * 100 + 400 // per_block + 400 // records_per_block)::bigint as stored_centi, (2 * codebook_bytes + 516 * (payload_blocks + rerank_blocks))::bigint as image_bytes from z")
def volume_layout(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as n", "array(16, 32, 8)[int(p_partkey % 3)] as m", "array(8, 4)[int(p_partkey % 2)] as b", "array(128, 768)[int(p_size % 2)] as d", "2 as copies")
    return M.layout(p).select("n", "m", "b", "d", "payload_bytes", "codebook_bytes", "per_block", "payload_blocks", "rerank_blocks", "payload_region", "replica_region", "stored_centi", "image_bytes")


@query("with r as (select l_orderkey, l_partkey * 100 + l_linenumber as addr, (l_quantity * 40)::bigint as len from lineitem), s as (select *, addr // 512 as lo, (addr + greatest(len, 1) - 1) // 512 as hi from r) select l_orderkey, count(*)::bigint as reads, sum(len)::bigint as bytes, sum(hi - lo + 1)::bigint as blocks, count_if(hi > lo)::bigint as straddling, (sum(hi - lo + 1) * 100 // count(*))::bigint as blocks_per_read_centi from s group by 1")
def access_stats(spark, sf):
    return I.access_stats(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey * 100 + l_linenumber as addr", "cast(l_quantity * 40 as long) as len"), "l_orderkey")


@query("with p as (select o_custkey as run, ['rotate', 'table', 'scan', 'rerank', 'finalize'][(o_orderkey % 5 + 1)::int] as phase, o_orderkey * 7919 % 100000 as ns from orders), t as (select run, phase, sum(greatest(0, ns - 2 * 400)) as corrected, least(sum(ns * 100000), 4294967295)::bigint as counter from p group by all) select run, phase, corrected::bigint as corrected, counter, (case when sum(corrected) over (partition by run) = 0 then 0 else corrected * 1000 // sum(corrected) over (partition by run) end)::bigint as share_permille from t")
def phase_shares(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey as run", "array('rotate', 'table', 'scan', 'rerank', 'finalize')[int(o_orderkey % 5)] as phase", "o_orderkey * 7919 % 100000 as ns")
    t = rows.groupBy("run", "phase").agg(F.sum(F.greatest(F.lit(0), F.col("ns") - 2 * 400)).alias("corrected"), F.least(F.sum(F.col("ns") * 100_000), F.lit((1 << 32) - 1)).alias("counter"))
    total = F.sum("corrected").over(Window.partitionBy("run"))
    return t.withColumn("all", total).selectExpr("run", "phase", "corrected", "counter", "case when all = 0 then 0 else corrected * 1000 div all end as share_permille")


@query(f"with {SCAN}, top as (select * from cand where rank <= 3) select qid, '{{\"qid\":' || qid || ',\"results\":[' || string_agg('{{\"id\":' || vec_id || ',\"score\":' || score || '}}', ',' order by rank) || ']}}' as document from top group by 1")
def search_documents(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    found = V.adc_scan(codes, queries, book, 3)
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("all"))
    results = F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    return lists.select("qid", F.to_json(F.struct("qid", results.alias("results"))).alias("document"))


TEXT = "select vec_id, case when vec_id % 10 = 3 then '' when vec_id % 10 = 5 then '1,x 3' when vec_id % 10 = 7 then '1 2' else (vec_id % 7) || ', ' || (vec_id % 11) || chr(9) || '0.5' end as line from embeddings"


@query(f"with t as ({TEXT}), p as (select vec_id as line_no, list_filter(regexp_split_to_array(line, '[, \\t]+'), lambda x: x <> '') as w from t), q as (select line_no, list_transform(w, lambda x: try_cast(x as double)) as q from p where len(w) > 0) select line_no, list_sum(q) as total, case when len(q) <> 3 then 'dimension ' || len(q) when len(list_filter(q, lambda x: x is null)) > 0 then 'component ' || (list_position(list_transform(q, lambda x: x is null), true) - 1) end as refused from q")
def text_queries(spark, sf):
    lines = _raw(spark, sf).selectExpr("vec_id as line_no", "case when vec_id % 10 = 3 then '' when vec_id % 10 = 5 then '1,x 3' when vec_id % 10 = 7 then '1 2' else concat(vec_id % 7, ', ', vec_id % 11, '\t', '0.5') end as line")
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return B.decode_text(lines, 3).select("line_no", total.alias("total"), "refused")


@query("with e as (select vec_id, case when vec_id % 9 = 4 then list_concat(embedding[1:5], ['nan'::float], embedding[7:]) when vec_id % 9 = 6 then embedding[1:63] else embedding end as v from embeddings) select vec_id, case when len(v) <> 64 then 'dimension ' || len(v) when len(list_filter(v, lambda x: isnan(x))) > 0 then 'component ' || (list_position(list_transform(v, lambda x: isnan(x)), true) - 1) end as refused from e")
def refused_queries(spark, sf):
    v = F.when(F.col("vec_id") % 9 == 4, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)))
    rows = _raw(spark, sf).withColumn("v", v.when(F.col("vec_id") % 9 == 6, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return rows.select("vec_id", B.refusal(F.col("v"), 64).alias("refused"))


@query(f"with {SCAN}, a as (select qid, rank, vec_id from cand where rank <= {TOP}), b as (select qid, rank, case when qid % 40 = 0 and rank = 2 then -1 else vec_id end as vec_id from a) select distinct qid from (from a except from b union (from b except from a))")
def answer_diff(spark, sf):
    """Queries whose answers differ from captured ones."""
    _, queries, book, codes = _setup(spark, sf)
    now = V.adc_scan(codes, queries, book, TOP).select("qid", "rank", "vec_id")
    then = now.withColumn("vec_id", F.when((F.col("qid") % 40 == 0) & (F.col("rank") == 2), F.lit(-1)).otherwise(F.col("vec_id")))
    return now.exceptAll(then).union(then.exceptAll(now)).select("qid").distinct()


# ---- parity and field arithmetic ------------------------------------------

MUL = "with recursive m(a, b, i, x, r) as (select a.a, b.b, 0, a.a, 0 from range(256) a(a) cross join range(256) b(b) union all select a, b, i + 1, case when x >= 128 then xor(x * 2, 285) else x * 2 end, case when (b >> i) & 1 = 1 then xor(r, x) else r end from m where i < 8), mul as materialized (select a::int as a, b::int as b, r::int as r from m where i = 8), inv as (select a, min(b)::int as b from mul where r = 1 group by 1)"


@query(f"{MUL} select a.a, b.b, xor(a.a, b.b)::int as sum_, (select r from mul where mul.a = a.a and mul.b = inv.b)::int as quotient, inv.b::int as inverse from (select unnest(range(256))::int as a) a cross join (select unnest(range(1, 256))::int as b) b join inv on inv.a = b.b")
def gf_divide(spark, sf):
    a = spark.range(256).select(F.col("id").cast("int").alias("a"))
    pairs = a.select("a", F.explode(F.sequence(F.lit(1), F.lit(255))).alias("b"))
    inverse = I.gf_inverse(F.col("b"))
    return pairs.select("a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("sum_"), I.gf_mul(F.col("a"), inverse).alias("quotient"), inverse.alias("inverse"))


@query(BYTES.join(["with recursive ", ""]) .replace("with recursive ", "with recursive " + MUL.removeprefix("with recursive ") + ", ") + f", parity as (select cell.block_no // 4 as stripe, i.i as shard, cell.p, bit_xor((select r from mul where mul.a = inv.b and mul.b = cell.v))::int as v from cell cross join range(2) i(i) join inv on inv.a = xor(4 + i.i, cell.block_no % 4) group by all) select stripe::bigint as stripe, shard::int as shard, p::int as p, v from parity")
def rs_parity(spark, sf):
    """Two parity shards of each stripe of four blocks."""
    return I.rs_encode(I.blocks(_setup(spark, sf)[3], SUBSPACES).select("block_no", "bytes"), 6, 4)
