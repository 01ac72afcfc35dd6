"""Document fingerprints by I-Match over randomised lexicon subsets, all in DataFrame operations.

Terms are the lower-cased words of the whole text. The lexicon is all terms whose
document frequency over all documents lies in a band (at least LEAST documents, at
most MOST of them). A document's fingerprint keeps the lexicon terms of its own
distinct terms, made up to FEW by the rarest above the band and then by those below
it (a group of near copies may be more than MOST of all documents, so that none of
its terms is in the band), sorts them and hashes the sorted terms of each of SUBSETS
randomised lexicon subsets. The subsets overlap: terms fall into SUBSETS classes by
hash, and each subset unites two classes, so each term is in two subsets.

A subset's hash survives an edit only if all its terms do, so subsets must be as
small as a handful of a document's terms. The subsets therefore come as a ladder,
each rung's drawn from half of the lexicon of the rung before. On the lower rungs of
a long document all hashes change with any edit, on the higher ones all subsets are
empty: its fingerprint writes out the rung on which it has SAMPLED to 2 * SAMPLED
terms and the next one (all terms, while there are fewer), which makes documents of
up to about twice the length comparable; others are unlike for their length alone.
The likeness of two fingerprints is the share of their non-empty subset hashes that
agree on the rung they share.

The document frequencies are shuffled as partial counts; only terms of the rungs
written out, a few dozen a document whatever its length, are joined with the lexicon.
Each step's shuffle files and tables go when the next one no longer reads them, so the
disk holds one step, not all of them.

Defined results: null text is empty; a text without terms has a hash of the whole
text as fingerprint, like only to itself; ids may be of any ordered type; a null id
comes last in descending order; equal rows have the same next document (the next
different row), which for a single row is itself; other columns are not read, so
they may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, drop, save, table

SUBSETS, APART, SAMPLED, LEAST, MOST, FEW = 64, 23, 24, 2, 0.05, 16
_DIGITS, _EMPTY = 4, "----"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def _sample(terms: Column, level: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int")) - 1
    return F.filter(terms, lambda t: t.bitwiseAND(mask) == 0)


def _level(n_terms: Column) -> Column:
    per = n_terms / F.lit(float(SAMPLED))
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(per, F.lit(1.0))))).cast("int")


def lexicon(docs: DataFrame, text: Column, least: int = LEAST, most: float = MOST) -> DataFrame:
    """(term hash, document frequency over all documents, in the band) of the terms of at least ``least`` documents."""
    terms = docs.select(F.explode(term_hashes(text)).alias("t"))
    n = docs.count()
    return terms.groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") >= least).select("t", "df", (F.col("df") <= max(float(least), most * n)).alias("band"))


def _block(terms: Column) -> Column:
    """Hashes of the subsets of sorted terms: subset j unites the classes j and j + APART."""
    share = lambda t: F.pmod(F.shiftright(t, 40), F.lit(SUBSETS)).cast("int")
    dealt = F.transform(terms, share)
    mine = lambda j: F.filter(terms, lambda t: share(t) == j)
    classes = F.array_distinct(dealt)
    hashes = F.map_from_arrays(classes, F.transform(classes, lambda j: F.xxhash64(mine(j))))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.element_at(m, j))
    turned = lambda d: F.concat(F.slice(d, APART + 1, SUBSETS - APART), F.slice(d, 1, APART))
    digits = lambda h: F.right(F.lpad(F.hex(h), _DIGITS, "0"), F.lit(_DIGITS))
    both = lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(_EMPTY)).otherwise(digits(F.xxhash64(x, y)))
    return F.array_join(let(let(hashes, dense), lambda d: F.zip_with(d, turned(d), both)), "")


def chosen(terms: Column, found: Column, few: int = FEW) -> Column:
    """Those of the terms that are in the band by ``found`` (df, t, band), ascending; made up to ``few``
    by the rarest above the band, then by those below it."""
    mine = F.filter(found, lambda s: F.array_contains(terms, s["t"]))  # found is in order of df
    kept = F.filter(mine, lambda s, i: s["band"] | (i < few))["t"]
    below = F.sort_array(F.array_except(terms, found["t"]))
    return F.sort_array(F.concat(kept, F.slice(below, F.lit(1), F.greatest(few - F.size(kept), F.lit(0)))))


def fingerprint(terms: Column, more: Column, level: Column, text_hash: Column) -> Column:
    """From the terms chosen of the samples of the document's level and of the next one."""
    parts = F.concat(F.lpad(level.cast("string"), 2, "0"), _block(terms), _block(more))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, F.concat(F.lit("text"), text_hash)).otherwise(parts)


def likeness(x: Column, y: Column) -> Column:
    """0 to 1, of two fingerprints."""
    width = SUBSETS * _DIGITS
    level = lambda f: f.substr(1, 2).try_cast("int")
    gap = level(x) - level(y)
    first, second = (lambda f: F.substring(f, 3, width)), (lambda f: F.substring(f, 3 + width, width))
    a = F.when(gap < 0, second(x)).otherwise(first(x))
    b = F.when(gap > 0, second(y)).otherwise(first(y))
    pieces = lambda f: F.regexp_extract_all(f, F.lit(f".{{{_DIGITS}}}"), F.lit(0))
    # 0: both empty, 1: alike, 2: not alike
    marks = F.zip_with(pieces(a), pieces(b), lambda v, w: F.when(v != w, 2).when(v == _EMPTY, 0).otherwise(1))
    share = lambda m: (F.size(m) - F.size(F.array_remove(m, 1))) / F.nullif(F.size(F.array_remove(m, 0)), F.lit(0))
    return F.when(x == y, F.lit(1.0)).when(gap.isNull() | (F.abs(gap) > 1), F.lit(0.0)).otherwise(F.coalesce(let(marks, share), F.lit(0.0)))


def following(keys: DataFrame) -> tuple[DataFrame, str]:
    """(k, h, n, nk, nh) and its stored ranges' path: each key's next one by descending id, nulls last, then by h; the
    last one's is the first. Ids are dealt to ranges, so no task orders more than a range;
    only the ranges' heads meet."""
    keys, path = save(keys.repartitionByRange(F.col("id").desc_nulls_last(), "h").withColumn("b", -F.spark_partition_id()), "keys", tidy=True)
    w = Window.partitionBy("b").orderBy(F.col("id").desc_nulls_last(), "h")
    led = keys.select("*", F.lead("k").over(w).alias("nk"), F.lead("h").over(w).alias("nh"), F.row_number().over(w).alias("r"))
    heads = led.where("r = 1").select("b", "k", "h")  # one row a range, whatever the number of rows
    first = F.max_by(F.struct("k", "h"), "b").over(Window.partitionBy())
    after = heads.withColumn("after", F.coalesce(F.lead(F.struct("k", "h")).over(Window.orderBy(F.col("b").desc())), first))
    after = after.select("b", F.col("after.k").alias("hk"), F.col("after.h").alias("hh"))
    pick = lambda x, y: F.when(F.col("nk").isNull(), F.col(y)).otherwise(F.col(x))
    return led.join(F.broadcast(after), "b", "left").select("k", "h", "n", pick("nk", "hk").alias("nk"), pick("nh", "hh").alias("nh")), path


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last 1/part is replaced by
    the beginning of the next document; see op10 for the columns."""
    spark = docs.sparkSession
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    base = docs.select(column(id_col).alias("id"), F.coalesce(column(id_col).cast("string"), F.lit("\x00")).alias("k"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    lex, p_lex = save(lexicon(docs, text), "lexicon", tidy=True)  # its shuffle goes before the texts are shuffled

    keys = base.groupBy("k", "h", "id").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("m"))
    led, p_keys = following(keys)
    pairs, p_pairs = save(led, "pairs", tidy=True)
    drop(spark, p_keys)
    texts = base.select("k", "h", "text")  # both joins below read one exchange of these
    single = texts
    if spark.read.parquet(p_pairs).count() < docs.count():  # equal rows: one of them is enough as next document
        single = single.dropDuplicates(["k", "h"])
    want = pairs.select("nk", "nh", "k", "h", F.floor(F.col("n") / part).cast("int").alias("need")).hint("shuffle_hash")
    s = single.alias("s")
    begin = s.join(want.alias("w"), (F.col("s.k") == F.col("w.nk")) & (F.col("s.h") == F.col("w.nh")))
    begin = begin.select(F.col("w.k"), F.col("w.h"), F.col("w.nk"), F.col("w.nh"), F.col("w.need"), F.expr("substring(s.text, 1, w.need)").alias("begin"))
    both = texts.join(begin.hint("shuffle_hash"), ["k", "h"])
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - need)"), "begin"))
    terms, more = term_hashes(F.col("text")), term_hashes(F.col("edited"))
    both = both.select("k", "h", "nk", "nh", F.length("text").alias("n"), F.sha2("edited", 256).alias("edited_sha256"), F.sha2("text", 256).alias("sha"), terms.alias("x"), more.alias("y"))
    both = both.withColumn("lx", _level(F.size("x"))).withColumn("ly", _level(F.size("y")))
    rows = both.select(F.monotonically_increasing_id().alias("rid"), "k", "h", "nk", "nh", "n", "edited_sha256", "sha", "lx", "ly", _sample(F.col("x"), F.col("lx")).alias("x"), _sample(F.col("y"), F.col("ly")).alias("y"))
    rows, p_rows = save(rows, "drafts", tidy=True)
    drop(spark, p_pairs)

    # sampled terms that are counted; a term of both texts is joined once
    found = rows.select("rid", F.explode(F.array_union("x", "y")).alias("t")).join(lex, "t").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "t", "band"))).alias("in"))
    none = F.array().cast("array<struct<df:long,t:long,band:boolean>>")
    prints = rows.join(found, "rid", "left").withColumn("in", F.coalesce("in", none))
    picks = lambda c, lv: (chosen(F.col(c), F.col("in")).alias(f"{c}1"), chosen(_sample(F.col(c), F.col(lv) + 1), F.col("in")).alias(f"{c}2"))
    prints = prints.select("k", "h", "nk", "nh", "n", "edited_sha256", "sha", "lx", "ly", *picks("x", "lx"), *picks("y", "ly"))
    prints = prints.select("k", "h", "nk", "nh", "n", "edited_sha256", fingerprint(F.col("x1"), F.col("x2"), F.col("lx"), F.col("sha")).alias("f"), fingerprint(F.col("y1"), F.col("y2"), F.col("ly"), F.col("edited_sha256")).alias("e"))
    prints, _ = save(prints, "prints", tidy=True)
    drop(spark, p_lex, p_rows)
    nexts = prints.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("f").alias("g")).groupBy("nk", "nh").agg(F.max("g").alias("g"))
    out = prints.join(nexts, ["nk", "nh"])
    id_type = docs.select(column(id_col)).schema[0].dataType
    return out.select(F.when(F.col("k") != "\x00", F.col("k").cast(id_type)).alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", F.col("f").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents").select("doc_id", "text"))
