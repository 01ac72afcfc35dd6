"""Queries over recall, labels, damage and protection, with their SQL oracles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import codes as C
from ..operators import damage as D
from ..operators import labels as L
from ..operators import vectors as V
from .catalog import AXIS, C8, CODES, DOT, DS, EVERY, M, R, SCAN, TABLES, TOP, TRUTH, TWO, E, K, _book, _components, _corpus, _raw, _setup, _tables, query

FD = f"fd as materialized (select q.vec_id as qid, c.vec_id, sum((q.x * (1 + q.vec_id % 5) - c.x * (1 + c.vec_id % 5)) ** 2) as dist from e q join e c using (i) where q.vec_id % {EVERY} = 0 group by all)"
FLOAT = f"{E}, {FD}"


def _floats(spark, sf):
    return _raw(spark, sf).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("v"))


@query(f"with {FLOAT} select qid, vec_id, round(dist, 6) as distance, row_number() over (partition by qid order by dist, vec_id)::int as rank from fd qualify rank <= {TOP}")
def exact_topk_l2_float(spark, sf):
    rows = _floats(spark, sf)
    out = V.exact_search(rows, rows.where(F.col("vec_id") % EVERY == 0), TOP, "l2", exact=False)
    return out.select("qid", "vec_id", F.round(F.abs("score"), 6).alias("distance"), "rank")


@query(f"with {SCAN}, {FD} select cand.qid, cand.vec_id, round(fd.dist, 6) as distance, row_number() over (partition by cand.qid order by fd.dist, cand.vec_id)::int as rank from cand join fd on fd.qid = cand.qid and fd.vec_id = cand.vec_id qualify row_number() over (partition by cand.qid order by fd.dist, cand.vec_id) <= {TOP}")
def rerank_l2_float(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    rows = _floats(spark, sf)
    out = V.rerank(V.adc_scan(codes, queries, book, R), rows, rows.where(F.col("vec_id") % EVERY == 0), TOP, metric="l2")
    return out.select("qid", "vec_id", F.round(F.abs("score"), 6).alias("distance"), "rank")


@query(f"with {SCAN}, {DOT}, {TRUTH}, g as (select * from (select unnest([10, 20, 50]) as depth) cross join (select unnest([1, 5, 10]) as k)), two as (select g.depth, g.k, cand.qid, cand.vec_id from g join cand on cand.rank <= g.depth join dots on dots.qid = cand.qid and dots.vec_id = cand.vec_id qualify row_number() over (partition by g.depth, g.k, cand.qid order by dots.score desc, cand.vec_id) <= g.k), t as (select g.*, qid, vec_id from g join truth on truth.rank <= g.k) select t.depth, t.k, avg(case when one.vec_id is null then 0 else 1 end)::double as stage_one, avg(case when two.vec_id is null then 0 else 1 end)::double as two_stage, avg(case when p.vec_id is null then 0 else 1 end)::double as present from t left join cand one on one.qid = t.qid and one.vec_id = t.vec_id and one.rank <= t.k left join cand p on p.qid = t.qid and p.vec_id = t.vec_id and p.rank <= t.depth left join two on two.qid = t.qid and two.vec_id = t.vec_id and two.depth = t.depth and two.k = t.k group by all")
def recall_by_depth(spark, sf):
    """One deep scan serves all depths: a shallower list is its prefix."""
    corpus, queries, book, codes = _setup(spark, sf)
    deep = V.adc_scan(codes, queries, book, R)
    scored = V.rerank(deep, corpus, queries, R).select("qid", "vec_id", F.col("rank").alias("by_score"), "score")
    deep = deep.select("qid", "vec_id", F.col("rank").alias("at")).join(scored.select("qid", "vec_id", "score"), ["qid", "vec_id"])
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(k).alias("k")) for d in (10, 20, 50) for k in (1, 5, 10)]))
    lists = deep.withColumn("g", grid).select("g.*", "qid", "vec_id", "at", "score").where("at <= depth")
    best = F.row_number().over(Window.partitionBy("depth", "k", "qid").orderBy(F.desc("score"), "vec_id"))
    lists = lists.withColumn("best", best)
    truth = V.exact_search(corpus, queries, TOP).withColumn("g", grid).select("g.*", "qid", "vec_id", F.col("rank").alias("place")).where("place <= k")
    rows = truth.join(lists, ["depth", "k", "qid", "vec_id"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.groupBy("depth", "k").agg(share(F.col("at") <= F.col("k")).alias("stage_one"), share(F.col("best") <= F.col("k")).alias("two_stage"), share(F.col("at").isNotNull()).alias("present"))


@query(f"with {CODES}, e1 as (select codes.j, sum((c8.v - book.w) * (c8.v - book.w)) / (count(*)::double) as mse from codes join c8 on c8.vec_id = codes.vec_id and c8.i // {DS} = codes.j join book on book.j = codes.j and book.c = codes.code and book.t = c8.i % {DS} group by 1) select round(avg(mse), 6) as mean_mse, round(max(mse), 6) as worst_mse, round(max(mse) / avg(mse), 6) as imbalance from e1")
def subspace_imbalance(spark, sf):
    corpus, _, book, codes = _setup(spark, sf)
    w = F.lit([[c.tolist() for c in j] for j in book.w])
    rows = corpus.join(codes, "vec_id").select("v", F.posexplode("codes").alias("j", "code"))
    off = F.aggregate(F.zip_with(F.slice("v", F.col("j") * DS + 1, DS), F.get(F.get(w, F.col("j")), F.col("code")), lambda a, b: ((a - b) * (a - b)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    mse = rows.groupBy("j").agg((F.sum(off) / (F.count("*") * DS)).alias("mse"))
    return mse.agg(F.round(F.avg("mse"), 6).alias("mean_mse"), F.round(F.max("mse"), 6).alias("worst_mse"), F.round(F.max("mse") / F.avg("mse"), 6).alias("imbalance"))


@query(f"with {TABLES} select qid, (count(*) * {DS})::bigint as macs from tab group by 1")
def adc_macs(spark, sf):
    return _tables(spark, sf, "ip").groupBy("qid").agg((F.count("*") * DS).alias("macs"))


@query(f"with {TABLES} select q.vec_id as qid, codes.vec_id, sum(q.v * book.w)::bigint as score from c8 q join book on book.j = q.i // {DS} and book.t = q.i % {DS} join codes on codes.j = book.j and codes.code = book.c where q.vec_id % {EVERY} = 0 group by q.vec_id, codes.vec_id qualify row_number() over (partition by q.vec_id order by sum(q.v * book.w) desc, codes.vec_id) <= {R}")
def adc_equals_direct_ip(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    return V.adc_scan(codes, queries, book, R, "ip").select("qid", "vec_id", "score")


# ---- labels ---------------------------------------------------------------


@query(f"with {AXIS}, lab as (select j, c, xor(r, r >> 1)::int as label from ranked) select codes.vec_id, codes.j::int as j, book.t::int as t, book.w from codes join book on book.j = codes.j and book.c = codes.code".replace(AXIS, CODES + AXIS[len(CODES.split(", dist as")[0]):]))
def permute_lossless(spark, sf):
    book, codes = _book(spark, sf), C.long_codes(_setup(spark, sf)[3])
    labels = L.gray_seed(book)
    moved, now = L.permute_book(book, labels), L.permute_codes(codes, labels)
    return now.join(moved.withColumnRenamed("c", "code"), ["j", "code"]).select("vec_id", "j", "t", "w")


@query(f"with {AXIS} select j, (count(distinct xor(r, r >> 1)) = count(*) and max(xor(r, r >> 1)) < count(*)) as valid from ranked group by 1")
def permutation_valid(spark, sf):
    return L.is_permutation(L.gray_seed(_book(spark, sf)))


@query()
def label_search(spark, sf):
    book = _book(spark, sf)
    return L.optimise(book, L.gray_seed(book))


# ---- damage ---------------------------------------------------------------

J, DELTA = 2, 4000
AIMS = TWO + ", " + TRUTH.replace("truth as (", "truth as materialized (") + f""", mine as (select vec_id, code as c from codes where j = {J}), near as (select qid, c as neighbour from truth join mine using (vec_id) where rank = 1),
 full_ as (select c, count(*) as n from mine group by 1), out_ as (select q.qid, min_by(f.c, (-f.n, f.c)) as outsider from (select distinct qid from truth) q cross join full_ f where not exists (select 1 from truth t join mine m on m.vec_id = t.vec_id where t.qid = q.qid and m.c = f.c) group by 1)"""


@query(f"with {AIMS} select near.qid, neighbour::int as neighbour, outsider::int as outsider from near left join out_ on out_.qid = near.qid")
def damage_aims(spark, sf):
    corpus, queries, _, codes = _setup(spark, sf)
    return D.aims(C.long_codes(codes), V.exact_search(corpus, queries, TOP), J)


SHIFT = SCAN + ", " + DOT + ", " + TRUTH + f""", sh as (select qid, scan.vec_id, scan.score + case when codes.code = 3 then {DELTA} else 0 end as score from scan join codes on codes.vec_id = scan.vec_id and codes.j = {J}),
 hurt as (select qid, vec_id, row_number() over (partition by qid order by score desc, vec_id)::int as rank, score::bigint as score from sh qualify rank <= {R})"""


@query(f"with {SHIFT} select qid, vec_id, score, rank from hurt")
def shifted_topr(spark, sf):
    _, queries, book, codes = _setup(spark, sf)
    return V.adc_scan(codes, queries, book, R, shift=(J, 3, DELTA))


LOSS = SHIFT + f""", intr as (select h.qid, count(*) as n from hurt h anti join cand on cand.qid = h.qid and cand.vec_id = h.vec_id join codes on codes.vec_id = h.vec_id and codes.j = {J} and codes.code = 3 group by 1)"""


@query(f"with {LOSS} select t.qid, count(c.vec_id)::bigint as clean_hits, count(h.vec_id)::bigint as hurt_hits, coalesce(max(intr.n), 0)::bigint as intruders from truth t left join cand c on c.qid = t.qid and c.vec_id = t.vec_id left join hurt h on h.qid = t.qid and h.vec_id = t.vec_id left join intr on intr.qid = t.qid group by 1")
def damage_compared(spark, sf):
    return _damage(spark, sf)[0]


def _damage(spark, sf):
    corpus, queries, book, codes = _setup(spark, sf)
    truth = V.exact_search(corpus, queries, TOP)
    clean, hurt = V.adc_scan(codes, queries, book, R), V.adc_scan(codes, queries, book, R, shift=(J, 3, DELTA))
    mine = codes.select("vec_id", F.get("codes", F.lit(J)).alias("code"))
    return D.compared(clean, hurt, truth, mine, F.col("code") == 3, TOP), truth, clean, mine


@query(f"with {LOSS} select t.qid, (least({TOP}, count(*) filter (codes.code = 3 or (coalesce(intr.n, 0) > 0 and coalesce(cand.rank - 1, {R}) > greatest(0, {R} - coalesce(intr.n, 0))))) / {TOP}.0)::double as bound from truth t join codes on codes.vec_id = t.vec_id and codes.j = {J} left join cand on cand.qid = t.qid and cand.vec_id = t.vec_id left join intr on intr.qid = t.qid group by 1")
def loss_bound(spark, sf):
    damage, truth, clean, mine = _damage(spark, sf)
    depths = truth.select("qid", "vec_id").join(clean.select("qid", "vec_id", F.col("rank").alias("at")), ["qid", "vec_id"], "left").join(mine, "vec_id")
    depths = depths.select("qid", F.coalesce(F.col("at") - 1, F.lit(R)).alias("depth"), (F.col("code") == 3).alias("affected"))
    return D.loss_bound(depths, damage, R, TOP)


SWEEP = SCAN + ", " + DOT + ", " + TRUTH.replace("truth as (", "truth as materialized (") + f""", sw as (select c.c, g.s, scan.qid, scan.vec_id, scan.score + case when codes.code = c.c then g.s * {DELTA} else 0 end as score from scan join codes on codes.vec_id = scan.vec_id and codes.j = {J} cross join (select unnest(range({K}))::int as c) c cross join (select unnest([1, -1]) as s) g),
 top as (select c, s, qid, vec_id from sw qualify row_number() over (partition by c, s, qid order by score desc, vec_id) <= {TOP * 2}),
 left_ as (select c, s, top.qid, count(*) as after from top join truth on truth.qid = top.qid and truth.vec_id = top.vec_id group by all),
 base as (select t.qid, count(c.vec_id) as before from truth t left join cand c on c.qid = t.qid and c.vec_id = t.vec_id and c.rank <= {TOP * 2} group by 1),
 lost as (select c.c, g.s, sum(greatest(0, base.before - coalesce(l.after, 0))) as lost from base cross join (select unnest(range({K}))::int as c) c cross join (select unnest([1, -1]) as s) g left join left_ l on l.qid = base.qid and l.c = c.c and l.s = g.s group by all),
 expo as (select c, sum(case when s = 1 then lost else 0 end)::bigint as inflate, sum(case when s = -1 then lost else 0 end)::bigint as deflate from lost group by 1)"""


@query(f"with {SWEEP} select c, inflate, deflate, greatest(inflate, deflate) as weight, row_number() over (order by greatest(inflate, deflate) desc, c)::int as rank from expo")
def exposure_weights(spark, sf):
    """True neighbours lost when a centroid's score is raised or lowered, over all queries."""
    return D.ranked_weights(D.exposure(_shifted(spark, sf)[0]))


def _shifted(spark, sf):
    """D.shift_sweep() of the fixture, then truth, the clean list and the codes of subspace J."""
    corpus, queries, book, codes = _setup(spark, sf)
    depth, mine = TOP * 2, F.get("codes", F.lit(J))
    few = V.adc_scan(codes, queries, book, depth, by=J).drop("rank")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    truth, clean = V.exact_search(corpus, queries, TOP), few.drop("code").withColumn("rank", best).where(F.col("rank") <= depth)
    seen = D.shift_sweep(few, clean, truth, K, DELTA, depth)
    return seen, truth, clean, codes.select("vec_id", mine.alias("c"))


CLAIMS = SWEEP + f""", intr2 as (select top.c, top.s, top.qid, count(*) as n from top anti join (select * from cand where rank <= {TOP * 2}) cl on cl.qid = top.qid and cl.vec_id = top.vec_id join codes on codes.vec_id = top.vec_id and codes.j = {J} and codes.code = top.c group by all),
 seen as (select c.c, g.s, base.qid, greatest(0, base.before - coalesce(l.after, 0)) as lost, coalesce(i.n, 0) as intruders from base cross join (select unnest(range({K}))::int as c) c cross join (select unnest([1, -1]) as s) g left join left_ l on l.qid = base.qid and l.c = c.c and l.s = g.s left join intr2 i on i.qid = base.qid and i.c = c.c and i.s = g.s),
 near as (select qid, code as c from truth join codes using (vec_id) where rank = 1 and j = {J}),
 mine as (select code as c, count(*) as n from codes where j = {J} group by 1),
 ends as (select max_by(c, n * 1000 + c) as heavy, min_by(c, n * 1000 + c) as light, max(n) as most, min(n) as least_ from mine),
 fan as (select sum(case when c = heavy then lost else 0 end) as x, sum(case when c = light then lost else 0 end) as y, any_value(most) as most, any_value(least_) as least_ from seen, ends where s = 1),
 defl as (select sum(lost) as x, sum(intruders) as y from seen join near using (qid, c) where s = -1),
 dire as (select sum(case when seen.c = near.c then lost else 0 end) as x, sum(case when seen.c = (near.c + 1) % {K} then lost else 0 end) as y from seen join near using (qid) where s = -1),
 bounds as (select seen.qid, seen.s, any_value(seen.lost) as lost, count(*) filter ((seen.s = -1 and codes.code = seen.c) or (seen.intruders > 0 and coalesce(cl.rank - 1, {TOP * 2}) > greatest(0, {TOP * 2} - seen.intruders))) as bound from seen join near using (qid, c) join truth on truth.qid = seen.qid join codes on codes.vec_id = truth.vec_id and codes.j = {J} left join (select * from cand where rank <= {TOP * 2}) cl on cl.qid = truth.qid and cl.vec_id = truth.vec_id group by 1, 2),
 brid as (select count_if(lost > bound) as x, count_if(lost > 0) as y from bounds)"""


@query(f"""with {CLAIMS} select 'fan-out' as claim, x::bigint as x, y::bigint as y, case when most < 2 * least_ then 'inconclusive' when x >= y then 'held' else 'refuted' end as verdict from fan
 union all select 'deflation channel', x::bigint, y::bigint, case when y > 0 then 'refuted' when x > 0 then 'held' else 'inconclusive' end from defl
 union all select 'directed sampling', x::bigint, y::bigint, case when x > y then 'held' when x = 0 and y = 0 then 'inconclusive' else 'refuted' end from dire
 union all select 'margin bridge', x::bigint, y::bigint, case when y = 0 then 'inconclusive' when x = 0 then 'held' else 'refuted' end from brid""")
def falsification_findings(spark, sf):
    return D.findings(*_shifted(spark, sf), K, TOP * 2, TOP)


@query("select p_partkey, p_size, (p_partkey * 37 % 11 - 5)::double as measured, relative_error, case when relative_error <= 0.5 or (predicted = 0 and measured = 0) then 'holds' else 'refuted' end as verdict from (select p_partkey, p_size, (p_size % 7 - 3)::double as predicted, (p_partkey * 37 % 11 - 5)::double as measured, case when predicted <> 0 then abs(measured - predicted) / abs(predicted) end as relative_error from part)")
def claim_verdicts(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", "p_size", "double(p_size % 7 - 3) as predicted", "double(p_partkey * 37 % 11 - 5) as measured", "0.5D as tolerance")
    return D.verdicts(rows).select("p_partkey", "p_size", "measured", "relative_error", "verdict")


FLIPS = "select vec_id, (vec_id % 8)::int as j, (1 << (vec_id % 4))::int as mask from embeddings union all select vec_id, ((vec_id * 3) % 8)::int, 1 from embeddings where vec_id % 3 = 0"


@query(f"with {CODES}, f as ({FLIPS}), x as (select vec_id, j, bit_xor(mask) as mask from f group by all) select codes.vec_id, codes.j::int as j, xor(codes.code, coalesce(x.mask, 0))::int as code from codes left join x on x.vec_id = codes.vec_id and x.j = codes.j")
def flip_code_bits(spark, sf):
    codes = C.long_codes(_setup(spark, sf)[3])
    ids = _raw(spark, sf).select("vec_id")
    flips = ids.selectExpr("vec_id", "cast(vec_id % 8 as int) as j", "shiftleft(1, cast(vec_id % 4 as int)) as mask")
    flips = flips.union(ids.where("vec_id % 3 = 0").selectExpr("vec_id", "cast(vec_id * 3 % 8 as int)", "1"))
    return D.flip_codes(codes, flips)


@query(f"with {C8}, t as (select a.vec_id, b.i, sum(a.v * case when bit_count(a.i::int & b.i::int) % 2 = 0 then 1 else -1 end)::bigint as v from c8 a join (select distinct i from c8) b on true group by all) select vec_id, (i // {DS})::int as j, sum(v * v)::bigint as energy from t group by all")
def subspace_energy(spark, sf):
    turned = _components(_corpus(spark, sf).select("vec_id", C.hadamard(F.col("v"), 64).alias("v")), "v")
    return turned.groupBy("vec_id", F.expr(f"cast(i div {DS} as int)").alias("j")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


@query(f"with {C8}, t as (select a.vec_id, b.i, sum(a.v * case when bit_count(a.i::int & b.i::int) % 2 = 0 then 1 else -1 end)::bigint as v from c8 a join (select distinct i from c8) b on true group by all) select vec_id, i::int as i, greatest(-128, least(127, v >> 4))::int as v from t")
def narrow_rotated(spark, sf):
    turned = _corpus(spark, sf).select("vec_id", C.hadamard(F.col("v"), 64).alias("v"))
    return _components(turned.select("vec_id", C.narrow_rotated(F.col("v"), 64).alias("v")), "v")


# ---- fault sweep ----------------------------------------------------------

#: Faults a channel and dose; a sector is a quarter of the fixture's codebook of 1024 bytes.
DOSES = [("clean", 0), ("codebook bits", 1), ("codebook bits", 16), ("codebook bits", 64), ("payload bits", 16), ("payload bits", 256), ("block drops", 1), ("block drops", 4), ("sector loss", 1)]
SECTOR, CODE_BITS, PER_BLOCK = 256, 4, 512 // M
FAULTS = D.draws(42, 256)


def _fault_sql(channels: str) -> str:
    """SQL of the sweep over the doses whose channel is in ``channels``."""
    size = M * K * DS
    return (
        f"with {SCAN}, {DOT}, {TRUTH.replace('truth as (', 'truth as materialized (')},"
        f" draws as (select * from (values {', '.join(f'({i}, {v}, {b})' for i, (v, b) in enumerate(FAULTS))}) t(i, v, b)),"
        f" dose as (select * from (values {', '.join(f'({c!r}, {d})' for c, d in DOSES)}) t(channel, dose) where channel in ('clean', {channels})),"
        " n as (select count(*) as n from embeddings),"
        f" bm as (select channel, dose, v % {size} as place, bit_xor(1 << b) as mask from draws join dose on channel = 'codebook bits' and i < dose group by all),"
        f" books as (select d.channel, d.dose, book.j, book.c, book.t, case when d.channel = 'sector loss' and ((book.j * {K} + book.c) * {DS} + book.t) // {SECTOR} = (select v % {size // SECTOR} from draws where i = 0) then -1"
        " else (xor((book.w + 256) % 256, coalesce(bm.mask, 0)) + 128) % 256 - 128 end as w"
        f" from dose d cross join book left join bm on bm.channel = d.channel and bm.dose = d.dose and bm.place = (book.j * {K} + book.c) * {DS} + book.t),"
        f" pm as (select channel, dose, v % (n * {M}) // {M} as vec_id, v % (n * {M}) % {M} as j, bit_xor(1 << (b % {CODE_BITS})) as mask from draws join dose on channel = 'payload bits' and i < dose cross join n group by all),"
        " stored as (select d.channel, d.dose, codes.vec_id, codes.j, xor(codes.code, coalesce(pm.mask, 0)) as code from dose d cross join codes left join pm on pm.channel = d.channel and pm.dose = d.dose and pm.vec_id = codes.vec_id and pm.j = codes.j),"
        f" hurt_tab as materialized (select b.channel, b.dose, q.vec_id as qid, b.j, b.c, sum(2 * q.v * b.w - b.w * b.w)::bigint as s from c8 q join books b on b.j = q.i // {DS} and b.t = q.i % {DS} where q.vec_id % {EVERY} = 0 group by all),"
        " hurt_scan as (select s.channel, s.dose, t.qid, s.vec_id, sum(t.s) as score from stored s join hurt_tab t on t.channel = s.channel and t.dose = s.dose and t.j = s.j and t.c = s.code group by all),"
        f" hurt_cand as (select channel, dose, qid, vec_id from hurt_scan qualify row_number() over (partition by channel, dose, qid order by score desc, vec_id) <= {R}),"
        f" gone as (select dose.dose, v % ((n + {PER_BLOCK - 1}) // {PER_BLOCK}) as block from draws join dose on channel = 'block drops' and i < dose cross join n group by all),"
        f" left_over as (select * from hurt_cand h where channel <> 'block drops' or not exists (select 1 from gone where gone.dose = h.dose and gone.block = h.vec_id // {PER_BLOCK})),"
        f" firsts as (select l.* from left_over l join dots on dots.qid = l.qid and dots.vec_id = l.vec_id qualify row_number() over (partition by l.channel, l.dose, l.qid order by dots.score desc, l.vec_id) <= {TOP}),"
        " got as (select dose.channel, dose.dose, count(truth.vec_id) / (select count(*) from truth)::double as recall from dose left join firsts f on f.channel = dose.channel and f.dose = dose.dose left join truth on truth.qid = f.qid and truth.vec_id = f.vec_id group by all)"
        " select channel, dose::int as dose, round(recall, 6) as recall, round((select recall from got where channel = 'clean') - recall, 6) as loss from got"
    )


def _fault_sweep(spark, sf, *channels: str):
    """(channel, dose, recall, loss): one compressed scan a damaged codebook or payload, one of the rest; one exact
    scoring of all their candidates."""
    corpus, queries, book, codes = _setup(spark, sf)
    n = corpus.count()
    doses = [d for d in DOSES if d[0] in ("clean", *channels)]
    # scans (codes, codebook), and the mask of the doses that each serves: the first one's blocks drop out of some
    scans, masks, dropped = [(codes, book)], [0], F.lit(0).cast("long")
    for i, (channel, dose) in enumerate(doses):
        bit, faults = 1 << i, FAULTS[:dose]
        if channel == "block drops":
            gone = sorted({place % -(-n // PER_BLOCK) for place, _ in faults}) if n else []
            dropped = dropped + F.when(F.expr(f"vec_id div {PER_BLOCK}").isin(gone), bit).otherwise(0)
        if channel in ("clean", "block drops"):
            masks[0] |= bit
            continue
        masks.append(bit)
        if channel == "payload bits":
            scans.append((D.flip_stored(codes, faults, n, M, CODE_BITS), book))
        else:
            scans.append((codes, V.Codebook(D.flip_book(book.w, faults) if channel == "codebook bits" else D.kill_unit(book.w, FAULTS[0][0], SECTOR)[0])))
    lists = [V.adc_lists(stored, queries, now, R).withColumn("mask", F.lit(mask).cast("long")) for (stored, now), mask in zip(scans, masks, strict=True)]
    found = V.ranked(functools.reduce(DataFrame.unionByName, lists), R, "mask")
    found = found.withColumn("mask", F.when(F.col("mask") == masks[0], F.col("mask") - dropped).otherwise(F.col("mask")))
    names = spark.createDataFrame([(i, *d) for i, d in enumerate(doses)], "list int, channel string, dose int")
    first = V.rerank_lists(found, len(doses), corpus, queries, TOP).join(F.broadcast(names), "list")  # a row a dose
    got = D.recall_after(first, V.exact_search(corpus, queries, TOP), names.select("channel", "dose"))
    clean = F.max(F.when(F.col("channel") == "clean", F.col("recall"))).over(Window.partitionBy())  # a row a dose
    return got.withColumn("loss", F.round(clean - F.col("recall"), 6)).withColumn("recall", F.round("recall", 6))


@query(_fault_sql("'codebook bits', 'payload bits', 'block drops', 'sector loss'"))
def fault_sweep(spark, sf):
    return _fault_sweep(spark, sf, "codebook bits", "payload bits", "block drops", "sector loss")


@query(_fault_sql("'payload bits'"))
def payload_bitflip_recall(spark, sf):
    return _fault_sweep(spark, sf, "payload bits")


@query(_fault_sql("'block drops'"))
def block_drop_recall(spark, sf):
    return _fault_sweep(spark, sf, "block drops")
