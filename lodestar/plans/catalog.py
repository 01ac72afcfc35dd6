"""Registered queries over the driver's tables, with their SQL oracles.

The fixtures are deterministic: rows of ``embeddings`` are narrowed to int8 by one
global scale after stretching row v by 1 + v % 5 (unit-norm rows would make all
metrics agree); centroid c of subspace j is the sub-vector of row c; the queries are
all rows whose id is divisible by EVERY, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import codes as C
from ..operators import integrity as I
from ..operators import labels as L
from ..operators import vectors as V

M, DS, K, EVERY, R, TOP = 8, 8, 16, 20, 50, 10


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("vec_id", V.narrow(F.col("embedding"), 1 + F.col("vec_id") % 5).alias("v"))


def _setup(spark, sf):
    corpus = _corpus(spark, sf)
    queries = corpus.where(F.col("vec_id") % EVERY == 0)
    book = V.Codebook.of_rows(corpus.where(F.col("vec_id") < K), M)
    return corpus, queries, book, V.encode(corpus, book)


def _book(spark: SparkSession, sf: str) -> DataFrame:
    """(j, c, t, w) of the codebook."""
    rows = _components(_corpus(spark, sf).where(F.col("vec_id") < K), "v")
    return rows.select(F.expr(f"cast(i div {DS} as int)").alias("j"), F.col("vec_id").cast("int").alias("c"), (F.col("i") % DS).cast("int").alias("t"), F.col("v").alias("w"))


def _components(df: DataFrame, col: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(col).alias("i", "v"))


# ---- SQL fragments --------------------------------------------------------

E = "e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)"
C8 = E + ", c8 as materialized (select vec_id, i::int as i, greatest(-127, least(127, round(x * ((1 + vec_id % 5) * 40.0))))::int as v from e)"
BOOK = C8 + f", book as (select (i // {DS})::int as j, vec_id::int as c, (i % {DS})::int as t, v as w from c8 where vec_id < {K})"
CODES = BOOK + f""", dist as materialized (select a.vec_id, b.j, b.c, sum((a.v - b.w) * (a.v - b.w)) as d from c8 a join book b on b.j = a.i // {DS} and b.t = a.i % {DS} group by all),
 codes as materialized (select vec_id, j, c as code from dist qualify row_number() over (partition by vec_id, j order by d, c) = 1)"""
TABLES = CODES + f""", tab as (select q.vec_id as qid, b.j, b.c, sum(q.v * b.w)::bigint as ip, sum(b.w * b.w)::bigint as nn from c8 q join book b on b.j = q.i // {DS} and b.t = q.i % {DS} where q.vec_id % {EVERY} = 0 group by all)"""
SCAN = TABLES + f""", scan as (select qid, vec_id, sum(2 * ip - nn)::bigint as score from codes join tab on tab.j = codes.j and tab.c = codes.code group by all),
 cand as (select *, row_number() over (partition by qid order by score desc, vec_id)::int as rank from scan qualify rank <= {R})"""
DOT = f"dots as materialized (select q.vec_id as qid, c.vec_id, sum(q.v * c.v)::bigint as score, sum((q.v - c.v) * (q.v - c.v))::bigint as dist from c8 q join c8 c using (i) where q.vec_id % {EVERY} = 0 group by all)"
TWO = SCAN + ", " + DOT + f""", two as (select cand.qid, cand.vec_id, dots.score, row_number() over (partition by cand.qid order by dots.score desc, cand.vec_id)::int as rank from cand join dots on dots.qid = cand.qid and dots.vec_id = cand.vec_id qualify row_number() over (partition by cand.qid order by dots.score desc, cand.vec_id) <= {TOP})"""
TRUTH = f"truth as (select qid, vec_id, row_number() over (partition by qid order by score desc, vec_id)::int as rank from dots qualify row_number() over (partition by qid order by score desc, vec_id) <= {TOP})"
POP = CODES + f", pop as (select j.j::int as j, c.c::int as code, count(codes.code)::bigint as population from range({M}) j(j) cross join range({K}) c(c) left join codes on codes.j = j.j and codes.code = c.c group by all)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- narrowing ------------------------------------------------------------


@query(f"with {E}, p as (select vec_id, max(abs(x)) as p from e group by 1) select vec_id, i::int as i, case when p = 0 then 0 else round(x / p * 127)::int end as v from e join p using (vec_id)")
def quantize_query_peak(spark, sf):
    return _components(_raw(spark, sf).select("vec_id", V.quantize_peak(F.col("embedding")).alias("v")), "v")


@query(f"with {E}, s as (select vec_id, i // {DS} as j, greatest(1, ceil(max(abs(x * 10)))) as n from e group by all) select e.vec_id, e.i::int as i, greatest(-127, least(127, round(x * 10 * 127 / n)))::int as v from e join s on s.vec_id = e.vec_id and s.j = e.i // {DS}")
def quantize_subspace_scale(spark, sf):
    ten = F.transform("embedding", lambda x: x.cast("double") * 10)
    return _components(_raw(spark, sf).select("vec_id", ten.alias("e")).select("vec_id", V.quantize_subspaces(F.col("e"), DS).alias("v")), "v")


@query(f"with {E} select vec_id, i::int as i, trunc(greatest(-128, least(127, x * 100 / 2)))::int as v from e")
def narrow_half_trunc(spark, sf):
    return _components(_raw(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), x.cast("double") * 100 / 2)).cast("int")).alias("v")), "v")


@query(f"with {E} select vec_id, i::int as i, round_even(x * 100 / 2, 0)::int as v from e")
def narrow_half_even(spark, sf):
    return _components(_raw(spark, sf).select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 100 / 2).cast("int")).alias("v")), "v")


@query(f"with {C8}, s as (select i // {DS} as j, greatest(1, ceil(max(abs(v)))) as n from c8 where vec_id < {K} group by 1) select vec_id::int as c, i::int as i, s.n::bigint as scale_num, greatest(-128, least(127, round(v::double / n * 127)))::int as w from c8 join s on s.j = c8.i // {DS} where vec_id < {K}")
def codebook_quantize(spark, sf):
    rows = _components(_corpus(spark, sf).where(F.col("vec_id") < K), "v").withColumn("j", F.expr(f"i div {DS}"))
    s = rows.groupBy("j").agg(F.greatest(F.lit(1), F.max(F.abs("v"))).cast("long").alias("scale_num"))
    w = F.greatest(F.lit(-128), F.least(F.lit(127), F.round(F.col("v").cast("double") / F.col("scale_num") * 127))).cast("int")
    return rows.join(F.broadcast(s), "j").select(F.col("vec_id").cast("int").alias("c"), "i", "scale_num", w.alias("w"))  # one row a subspace


@query(f"with {C8} select a.vec_id, a.i, a.v, b.v as w, (abs(a.v) * abs(b.v))::bigint as bound from c8 a join c8 b on b.i = a.i and b.vec_id = a.vec_id % {K}")
def score_shift_bound(spark, sf):
    rows = _components(_corpus(spark, sf), "v")
    other = rows.where(F.col("vec_id") < K).select(F.col("vec_id").alias("c"), "i", F.col("v").alias("w"))
    return rows.withColumn("c", F.col("vec_id") % K).join(other, ["c", "i"]).select("vec_id", "i", "v", "w", (F.abs("v") * F.abs("w")).cast("long").alias("bound"))


# ---- exact search ---------------------------------------------------------


@query(f"with {C8}, {DOT} select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id)::int as rank from dots qualify rank <= {TOP}")
def exact_topk_ip_int8(spark, sf):
    corpus, queries, *_ = _setup(spark, sf)
    return V.exact_search(corpus, queries, TOP, "ip")


@query(f"with {C8}, {DOT} select qid, vec_id, (-dist)::bigint as score, row_number() over (partition by qid order by dist, vec_id)::int as rank from dots qualify rank <= {TOP}")
def exact_topk_l2_int8(spark, sf):
    corpus, queries, *_ = _setup(spark, sf)
    return V.exact_search(corpus, queries, TOP, "l2")


# ---- compressed search ----------------------------------------------------


@query(f"with {CODES} select vec_id, j::int as j, code::int as code from codes")
def encode_codes(spark, sf):
    return C.long_codes(_setup(spark, sf)[3])


@query(f"with {POP} select * from pop")
def populations(spark, sf):
    return C.populations(_setup(spark, sf)[3], M, K)


@query(f"with {POP}, a as (select j, (sum(population) * 1024 // count(*))::bigint as mean_x1024, max(population)::bigint as max_population from pop group by 1) select *, (max_population * 1024 * 1024 // mean_x1024)::bigint as skew_x1024 from a")
def population_skew(spark, sf):
    return C.skew(C.populations(_setup(spark, sf)[3], M, K))


@query(f"with {POP}, r as (select *, row_number() over (partition by j order by population desc, code) as r from pop) select j, (sum(case when r <= 3 then population else 0 end) * 1000000 // sum(population))::bigint as share_ppm from r group by 1")
def top_share_ppm(spark, sf):
    return C.top_share(C.populations(_setup(spark, sf)[3], M, K), 3)


def _tables(spark, sf, metric):
    corpus, queries, book, _ = _setup(spark, sf)
    w = F.lit([[c.tolist() for c in j] for j in book.w])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)
    part = queries.select(F.col("vec_id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(M - 1))).alias("j"), "v").withColumn("q", F.slice("v", F.col("j") * DS + 1, DS))
    rows = part.select("qid", "j", "q", F.posexplode(F.get(w, F.col("j"))).alias("c", "w"))
    score = dot(F.col("q"), F.col("w"))
    return rows.select("qid", "j", "c", (score if metric == "ip" else 2 * score - dot(F.col("w"), F.col("w"))).alias("score"))


@query(f"with {TABLES} select qid, j, c, ip as score from tab")
def adc_table_ip(spark, sf):
    return _tables(spark, sf, "ip")


@query(f"with {TABLES} select qid, j, c, (2 * ip - nn)::bigint as score from tab")
def adc_table_l2(spark, sf):
    return _tables(spark, sf, "l2")


@query(f"with {SCAN} select qid, vec_id, score, rank from cand")
def adc_scan_topr(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    return V.adc_scan(codes, queries, book, R)


@query(f"with {SCAN} select qid, vec_id, score, rank from cand where rank <= {TOP}")
def stage_one_only(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    return V.adc_scan(codes, queries, book, TOP)


@query(f"with {TWO} select qid, vec_id, score, rank from two")
def two_stage_search(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    return V.search(corpus, codes, queries, book, TOP, R)


@query(f"with {SCAN}, {DOT}, kept as (select cand.qid, cand.vec_id, dots.score from cand join dots on dots.qid = cand.qid and dots.vec_id = cand.vec_id where cand.vec_id % 7 <> 3) select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id)::int as rank from kept qualify rank <= {TOP}")
def rerank_with_drops(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    return V.rerank(V.adc_scan(codes, queries, book, R), corpus.where("vec_id % 7 <> 3"), queries, TOP)


@query(f"with {SCAN} select qid, count(*)::bigint as candidates, count(*) filter (vec_id % 7 = 3)::bigint as dropped, bool_or(vec_id % 7 = 3) as degraded from cand group by 1")
def degraded_flag(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    lost = F.col("vec_id") % 7 == 3
    return V.adc_scan(codes, queries, book, R).groupBy("qid").agg(F.count("*").alias("candidates"), F.count_if(lost).alias("dropped"), F.bool_or(lost).alias("degraded"))


# ---- recall ---------------------------------------------------------------


@query(f"with {SCAN}, {DOT}, {TRUTH}, d as (select unnest([10, 20, 50]) as depth) select d.depth::int as depth, (count(cand.vec_id) / (count(*)::double))::double as present from d cross join truth left join cand on cand.qid = truth.qid and cand.vec_id = truth.vec_id and cand.rank <= d.depth group by 1")
def present_in_candidates(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    deep = V.adc_scan(codes, queries, book, R).select("qid", "vec_id", F.col("rank").alias("at"))
    truth = V.exact_search(corpus, queries, TOP)
    depths = F.explode(F.array(*map(F.lit, (10, 20, 50)))).alias("depth")
    return truth.join(deep, ["qid", "vec_id"], "left").select("at", depths).groupBy("depth").agg((F.count_if(F.col("at") <= F.col("depth")) / F.count("*")).alias("present"))


@query(f"with {TWO}, {TRUTH} select truth.qid, count(two.vec_id)::bigint as hits, (count(two.vec_id) / 10.0)::double as recall from truth left join two on two.qid = truth.qid and two.vec_id = truth.vec_id group by 1")
def recall_two_stage(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    return V.recall(V.search(corpus, codes, queries, book, TOP, R), V.exact_search(corpus, queries, TOP), TOP)


@query(f"with {SCAN}, {DOT}, {TRUTH} select truth.qid, truth.vec_id, coalesce(cand.rank - 1, {R})::int as depth from truth left join cand on cand.qid = truth.qid and cand.vec_id = truth.vec_id")
def neighbour_depths(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    deep = V.adc_scan(codes, queries, book, R).select("qid", "vec_id", F.col("rank").alias("at"))
    return V.exact_search(corpus, queries, TOP).join(deep, ["qid", "vec_id"], "left").select("qid", "vec_id", F.coalesce(F.col("at") - 1, F.lit(R)).alias("depth"))


@query(f"with {SCAN}, {DOT}, {TRUTH} select cand.qid, cand.vec_id from cand anti join truth on truth.qid = cand.qid and truth.vec_id = cand.vec_id where cand.rank <= {TOP}")
def intruders(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    return V.adc_scan(codes, queries, book, TOP).join(V.exact_search(corpus, queries, TOP), ["qid", "vec_id"], "leftanti").select("qid", "vec_id")


# ---- training -------------------------------------------------------------


@query(f"with {CODES}, n as (select j, code, count(*) as n from codes group by all), s as (select codes.j, codes.code, c8.i % {DS} as t, sum(c8.v) as s from codes join c8 on c8.vec_id = codes.vec_id and c8.i // {DS} = codes.j group by all) select book.j::int as j, book.c::int as c, book.t::int as t, coalesce(round_even(s.s / n.n::double, 0), book.w)::int as w from book left join n on n.j = book.j and n.code = book.c left join s on s.j = book.j and s.code = book.c and s.t = book.t")
def kmeans_one_step(spark, sf):
    corpus, _, book, _ = _setup(spark, sf)
    new = book.lloyd(corpus, 1)
    rows = [(j, c, t, int(new.w[j, c, t])) for j in range(M) for c in range(K) for t in range(DS)]
    return spark.createDataFrame(rows, "j int, c int, t int, w int")


@query(f"with {CODES} select codes.j::int as j, round(sum((c8.v - book.w) * (c8.v - book.w)) / (count(*)::double), 6) as mse from codes join c8 on c8.vec_id = codes.vec_id and c8.i // {DS} = codes.j join book on book.j = codes.j and book.c = codes.code and book.t = c8.i % {DS} group by 1")
def reconstruction_mse(spark, sf):
    corpus, _, book, codes = _setup(spark, sf)
    w = F.lit([[c.tolist() for c in j] for j in book.w])
    rows = corpus.join(codes, "vec_id").select("v", F.posexplode("codes").alias("j", "code"))
    error = F.aggregate(F.zip_with(F.slice("v", F.col("j") * DS + 1, DS), F.get(F.get(w, F.col("j")), F.col("code")), lambda a, b: ((a - b) * (a - b)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.groupBy("j").agg(F.round(F.sum(error) / (F.count("*") * DS), 6).alias("mse"))


# ---- labels and transforms ------------------------------------------------


#: Ranks of centroids along the component of widest spread, the first on ties.
AXIS = BOOK + """, axis as (select j, min_by(t, (-s, t)) as t from (select j, t, max(w) - min(w) as s from book group by all) group by 1),
 ranked as (select j, c, (row_number() over (partition by j order by w, c) - 1)::int as r from book join axis using (j, t))"""


@query(f"with {AXIS} select j, c, xor(r, r >> 1)::int as label from ranked")
def gray_seed_labels(spark, sf):
    return L.gray_seed(_book(spark, sf))


@query(f"with {BOOK}, b as (select unnest(range(4))::int as l) select a.j, avg(d)::double as mean_sq from (select a.j, a.c, l, sum((a.w - z.w) * (a.w - z.w)) as d from book a cross join b join book z on z.j = a.j and z.t = a.t and z.c = xor(a.c, (1 << l)) group by all) a group by 1")
def hamming_displacement(spark, sf):
    rows = _components(_corpus(spark, sf).where(F.col("vec_id") < K), "v").select(F.expr(f"cast(i div {DS} as int)").alias("j"), F.col("vec_id").cast("int").alias("c"), (F.col("i") % DS).alias("t"), "v")
    flipped = rows.select("j", "t", F.col("v").alias("w"), F.explode(F.array(*map(F.lit, range(4)))).alias("l"), "c").withColumn("z", F.col("c").bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("l"))))
    far = rows.select("j", "t", F.col("c").alias("z"), "v")
    d = flipped.join(far, ["j", "t", "z"]).groupBy("j", "c", "l").agg(F.sum((F.col("w") - F.col("v")) * (F.col("w") - F.col("v"))).alias("d"))
    return d.groupBy("j").agg(F.avg("d").alias("mean_sq"))


@query(f"with {C8}, t as (select a.vec_id, b.i, sum(a.v * case when bit_count(a.i::int & b.i::int) % 2 = 0 then 1 else -1 end)::bigint as v from c8 a join (select distinct i from c8) b on true group by all) select vec_id, i::int as i, v from t")
def hadamard(spark, sf):
    return _components(_corpus(spark, sf).select("vec_id", C.hadamard(F.col("v"), 64).alias("v")), "v")


@query(f"with {C8} select a.vec_id, a.i, (case when a.i % 2 = 0 then a.v + b.v else b.v - a.v end)::bigint as v from c8 a join c8 b on a.vec_id = b.vec_id and b.i = xor(a.i, 1)")
def kac_step(spark, sf):
    return _components(_corpus(spark, sf).select("vec_id", C.kac(F.col("v"), 64).alias("v")), "v")


@query(f"with {C8} select vec_id, i, v::bigint as v from c8")
def rotate_round_trip(spark, sf):
    there = _corpus(spark, sf).select("vec_id", C.rotate(F.col("v"), 64).alias("v"))
    return _components(there.select("vec_id", C.unrotate(F.col("v"), 64).alias("v")), "v")


@query(f"with {C8} select vec_id, (128 * sum(v * v))::bigint as energy from c8 group by 1")
def rotate_energy(spark, sf):
    turned = _corpus(spark, sf).select("vec_id", C.rotate(F.col("v"), 64).alias("v"))
    return turned.select("vec_id", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("energy"))


@query(f"with {CODES} select vec_id, (j // 2)::int as i, sum(code * case when j % 2 = 0 then 1 else 16 end)::int as v from codes group by all")
def pack_b4(spark, sf):
    return _components(_setup(spark, sf)[3].select("vec_id", C.pack_nibbles(F.col("codes")).alias("v")), "v")


@query(f"with {CODES} select vec_id, j::int as i, code::int as v from codes")
def unpack_b4(spark, sf):
    packed = _setup(spark, sf)[3].select("vec_id", C.pack_nibbles(F.col("codes")).alias("p"))
    return _components(packed.select("vec_id", C.unpack_nibbles(F.col("p")).alias("v")), "v")


@query("select v.v::int as v, b.b::int as bit, abs((case when u > 127 then u - 256 else u end) - v.v)::int as moved from range(-128, 128) v(v) cross join range(8) b(b), lateral (select xor(((v.v + 256) % 256)::int, (1 << b.b)::int) as u)")
def flip_displacement(spark, sf):
    v = spark.range(-128, 128).select(F.col("id").cast("int").alias("v"))
    return v.select("v", F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), C.flip_displacement(F.col("v"), b).alias("moved")) for b in range(8)])).alias("x")).select("v", "x.bit", "x.moved")


# ---- storage --------------------------------------------------------------


@query("select vec_id from embeddings where vec_id < 300 or (vec_id >= 360 and vec_id < 480)")
def stored_ids_with_gap(spark, sf):
    return _raw(spark, sf).where(I.stored(F.col("vec_id"), 300, 360, 480)).select("vec_id")


@query("select v as vec_id, case when v >= 0 and (v < 300 or (v >= 360 and v < 480)) then 'stored' when v >= 0 and v < 480 then 'absent' else 'out of range' end as status from range(290, 490) r(v)")
def record_status(spark, sf):
    return spark.range(290, 490).select(F.col("id").alias("vec_id"), I.status(F.col("id"), 300, 360, 480).alias("status"))


@query("select m::int as m, d::int as d, lcm(512 // m, greatest(1, 512 // d))::bigint as append_unit, (512 - (512 // m) * m)::int as slack from (select unnest([4, 8, 16, 24, 32]) as m) cross join (select unnest([64, 128, 768]) as d)")
def append_unit(spark, sf):
    import math

    rows = [(m, d, math.lcm(512 // m, max(1, 512 // d)), 512 - (512 // m) * m) for m in (4, 8, 16, 24, 32) for d in (64, 128, 768)]
    return spark.createDataFrame(rows, "m int, d int, append_unit long, slack int")


@query("select m::int as m, b::int as b, ((1 << b) * d)::bigint as codebook_bytes, (m * b // 8)::bigint as payload_bytes, (m * (1 << b) * 4)::bigint as table_bytes, ((1 << b) * d)::bigint as macs from (select unnest([15, 30, 60, 120]) as m) cross join (select unnest([4, 6, 8]) as b) cross join (select 960 as d)")
def profile_budget(spark, sf):
    m = spark.createDataFrame([(m, b) for m in (15, 30, 60, 120) for b in (4, 6, 8)], "m int, b int")
    return m.selectExpr("m", "b", "cast(shiftleft(1, b) * 960 as long) as codebook_bytes", "cast(m * b div 8 as long) as payload_bytes", "cast(m * shiftleft(1, b) * 4 as long) as table_bytes", "cast(shiftleft(1, b) * 960 as long) as macs")


@query("select vec_id, (vec_id // 64)::bigint as block_no, (vec_id % 64)::bigint as slot, ((vec_id // 64) * 512 + (vec_id % 64) * 8)::bigint as byte_offset from embeddings")
def layout_offsets(spark, sf):
    return _raw(spark, sf).selectExpr("vec_id", "vec_id div 64 as block_no", "vec_id % 64 as slot", "(vec_id div 64) * 512 + (vec_id % 64) * 8 as byte_offset")


#: Bytes of the code blocks, padded with 255, and their CRC-32 a byte at a time.
BYTES = CODES + f""", cell as (select b.b as block_no, p.p, coalesce(codes.code, 255)::bigint as v from range((select max(vec_id) // {512 // M} + 1 from embeddings)) b(b) cross join range(512) p(p)
 left join codes on codes.vec_id = b.b * {512 // M} + p.p // {M} and codes.j = p.p % {M})"""


def _crc_step(x: str) -> str:
    """Eight shifts of the reflected polynomial."""
    return f"list_reduce([{x}, 0, 1, 2, 3, 4, 5, 6, 7], lambda s, i: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)"


CRC = BYTES + f""", bytes as (select block_no, list(v order by p) as l from cell group by 1),
 crc as (select block_no, xor(list_reduce(list_prepend(4294967295::bigint, l), lambda c, v: {_crc_step("xor(c, v)")}), 4294967295)::bigint as crc from bytes)"""


@query(f"with {CRC} select block_no::bigint as block_no, crc from crc")
def block_crc(spark, sf):
    return I.blocks(_setup(spark, sf)[3], M).select("block_no", "crc")


#: A damaged copy: blocks whose number leaves 2 by 3 have their byte 7 changed.
HURT = BYTES + ", hurt as (select block_no, p, v, case when block_no % 3 = 2 and p = 7 then xor(v, 16) else v end as u from cell)"


def _hurt(blocks: DataFrame) -> DataFrame:
    h = F.hex("bytes")
    byte = F.lpad(F.hex(F.conv(F.substring(h, 15, 2), 16, 10).cast("int").bitwiseXOR(F.lit(16))), 2, "0")
    changed = F.unhex(F.concat(F.substring(h, 1, 14), byte, F.substring(h, 17, 1 << 20)))
    return blocks.withColumn("bytes", F.when(F.col("block_no") % 3 == 2, changed).otherwise(F.col("bytes")))


@query(f"with {HURT} select block_no::bigint as block_no, bool_and(u = v) as ok from hurt group by 1")
def verify_report(spark, sf):
    good = I.blocks(_setup(spark, sf)[3], M)
    return I.verify(_hurt(good), good.select("block_no", "crc"))


@query(f"with {HURT} select distinct block_no::bigint as block_no from hurt where u <> v")
def replica_diff(spark, sf):
    good = I.blocks(_setup(spark, sf)[3], M)
    copy = _hurt(good).select("block_no", F.col("bytes").alias("other"))
    return good.join(copy, "block_no").where("bytes <> other").select("block_no")


SLOTS = "select o_custkey as volume, o_orderkey as sequence, o_custkey + o_orderkey % 97 as n, o_orderkey % 5 <> 1 as valid from orders"


@query(f"with s as ({SLOTS}) select volume, sequence, n::bigint as n from s where valid qualify row_number() over (partition by volume order by sequence desc) = 1")
def live_manifest(spark, sf):
    slots = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey as volume", "o_orderkey as sequence", "cast(o_custkey + o_orderkey % 97 as long) as n", "o_orderkey % 5 <> 1 as valid")
    return I.live_manifest(slots, "volume").select("volume", "sequence", "n")


@query("with recursive m(a, b, i, x, r) as (select a.a, b.b, 0, a.a, 0 from range(256) a(a) cross join range(256) b(b) union all select a, b, i + 1, case when x >= 128 then xor(x * 2, 285) else x * 2 end, case when (b >> i) & 1 = 1 then xor(r, x) else r end from m where i < 8) select a::int as a, b::int as b, r::int as product from m where i = 8")
def gf_mul(spark, sf):
    a = spark.range(256).select(F.col("id").cast("int").alias("a"))
    pairs = a.select("a", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("b"))
    return pairs.select("a", "b", I.gf_mul(F.col("a"), F.col("b")).alias("product"))


REGIONS = "select p_partkey::varchar as name, (p_partkey * 7919 % 200000)::bigint as base, (p_size * 211)::bigint as extent from part"


@query(f"with r as ({REGIONS}) select a.name as a, b.name as b from r a join r b on a.name < b.name and a.base < b.base + b.extent and b.base < a.base + a.extent")
def region_overlap(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return C.intervals_overlap(part.selectExpr("cast(p_partkey as string) as name", "p_partkey * 7919 % 200000 as base", "cast(p_size * 211 as long) as extent"))


# ---- faults and protection ------------------------------------------------


@query(f"with {CODES}, w as (select code, count(*)::bigint as weight from codes group by 1), b as (select code, weight, ntile(4) over (order by weight desc, code) as bucket from w) select bucket::int as bucket, min(code)::int as low, count(*)::bigint as n, sum(weight)::bigint as weight from b group by 1")
def ntile_groups(spark, sf):
    w = C.long_codes(_setup(spark, sf)[3]).groupBy("code").agg(F.count("*").alias("weight"))
    # at most 2**b rows, one a centroid
    b = w.withColumn("bucket", F.ntile(4).over(Window.orderBy(F.desc("weight"), "code")))
    return b.groupBy("bucket").agg(F.min("code").alias("low"), F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(f"with {CODES}, w as (select code, count(*)::bigint as weight from codes group by 1), b as (select bucket, sum(weight)::bigint as weight from (select weight, ntile(4) over (order by weight desc, code) as bucket from w) group by 1), r as (select * from (values (0, 90), (2, 40), (5, 10)) r(cost, residual)), x as (select a.weight * p.residual + b2.weight * q.residual + c.weight * s.residual + d.weight * t.residual as objective, p.cost + q.cost + s.cost + t.cost as spent from b a, b b2, b c, b d, r p, r q, r s, r t where a.bucket = 1 and b2.bucket = 2 and c.bucket = 3 and d.bucket = 4) select objective::bigint as objective, spent::bigint as spent from x where spent <= 9 order by objective, spent limit 1")
def rate_exhaustive(spark, sf):
    return I.best_rates(ntile_groups(spark, sf).select("bucket", "weight"), [(0, 0, 90), (1, 2, 40), (2, 5, 10)], 9)


@query(f"with {TABLES}, flip as (select vec_id, j, case when vec_id % 11 = 4 and j = 3 then xor(code, 1) else code end as code from codes), s as (select qid, vec_id, sum(2 * ip - nn)::bigint as score from flip join tab on tab.j = flip.j and tab.c = flip.code group by all) select qid, vec_id, score, row_number() over (partition by qid order by score desc, vec_id)::int as rank from s qualify rank <= {R}")
def payload_bitflip_scan(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    flipped = F.transform("codes", lambda c, j: F.when((F.col("vec_id") % 11 == 4) & (j == 3), c.bitwiseXOR(F.lit(1))).otherwise(c))
    return V.adc_scan(codes.withColumn("codes", flipped), queries, book, R)


@query(f"with {SCAN} select qid, vec_id, row_number() over (partition by qid order by score desc, vec_id)::int as rank from scan where vec_id // 64 not in (1, 4) qualify rank <= {TOP}")
def block_drop_search(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    lost = spark.createDataFrame([(1,), (4,)], "block long").select(F.explode(F.sequence(F.col("block") * 64, F.col("block") * 64 + 63)).alias("vec_id"))
    return V.adc_scan(codes.join(lost, "vec_id", "leftanti"), queries, book, TOP).select("qid", "vec_id", "rank")


@query("with l as (select i as seq, (i * 7 + 1) % 16 as page, case when (i * 5 + 1) % 3 = 0 then 'erase' else 'program' end as op from range(400) r(i)), m as (select *, lag(op) over (partition by page order by seq) as before from l) select (select count(*) from m where op = 'program' and before = 'program')::bigint as double_programs, (select count(*) from (select page from l where op = 'erase' group by 1 having count(*) > 8))::bigint as worn_pages")
def flash_faults(spark, sf):
    return I.flash_faults(I.events_of(spark, 400), 8)


@query("select l_returnflag, l_quantity, l_extendedprice from (select distinct l_returnflag, l_quantity, l_extendedprice from lineitem) a where not exists (select 1 from (select l_returnflag, l_quantity, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2) b where b.l_returnflag = a.l_returnflag and b.l_quantity <= a.l_quantity and b.l_extendedprice >= a.l_extendedprice and (b.l_quantity < a.l_quantity or b.l_extendedprice > a.l_extendedprice))")
def pareto_front(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_extendedprice")
    best = rows.groupBy("l_returnflag", "l_quantity").agg(F.max("l_extendedprice").alias("l_extendedprice"))  # the best of each cost
    return C.pareto(best, "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("select quantile_disc(score, 0.5)::bigint as p50, quantile_disc(score, 0.95)::bigint as p95 from (with " + C8 + ", " + DOT + " select score from dots)")
def score_percentiles(spark, sf):
    corpus, queries, *_ = _setup(spark, sf)
    return V.percentiles(V.score_histogram(corpus, queries), {"p50": 0.5, "p95": 0.95})


def queries() -> dict:
    from . import analysis, storage  # noqa: F401  they add their queries

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
