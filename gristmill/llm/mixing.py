"""Operator 8. Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / w, with u in (0, 1) from a hash of its id and w its quality weight (a column, or the share of
letters in its text). Within a source documents come in ascending order of key, and the prefix whose tokens (of the tokenizer, or
words) stay within the source's budget is selected. A budget of several times the source's tokens takes so many complete epochs of every
document first; only the rest is selected by key. The budget of a source is total * weight / sum of weights, in integers.
By default the weight of a source is the integer square root of its tokens and the total is the input's tokens.

No source is ever sorted as a whole, so that a hot source is no bottleneck: tokens are summed by (source, bin of key),
the bins' prefix sums find the bin in which the budget ends, and only that bin of each source is ordered by key and id. That gives
the last key and id selected; a second pass over the documents computes their keys again and compares, so that no text is
exchanged and tokens are counted once. The result is that of the full sort.

Defined cases: a NULL or empty text has no tokens and is left out; a NULL source is a source of its own; a source that
``weights`` doesn't name has weight 0; a quality weight that is NULL or not above 0 leaves the document out; equal keys go by id; rows that share an id are numbered and drawn each on its own;
other columns come out unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import mix32
from gristmill.llm.common import small_batches, unpacked, with_row_id, written
from gristmill.llm.tokens import PATH, counted

SEED = 20
BINS = 65536


def _uniform(rid: Column, seed: int) -> Column:
    """53 bits of hash in (0, 1)."""
    m = F.lit(1 << 31)
    h1 = mix32(F.pmod(rid + F.lit(seed), m))
    h2 = mix32(F.shiftright(h1, 1).bitwiseXOR(F.pmod(F.shiftright(rid, 31), m)))
    return ((h1 * F.lit(1 << 20)).cast("double") + F.shiftright(h2, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _keyed(docs: DataFrame, seed: int, quality: str | None) -> DataFrame:
    """(row, rid, src, key) of the documents that have text and weight."""
    keyed, _ = with_row_id(docs)
    text = F.col("row").getField("text")
    if quality is None:
        letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
        w = (letters + 1).cast("double") / (F.length(text) + 1).cast("double")
    else:
        w = F.col("row").getField(quality).cast("double")
    d = keyed.filter(F.octet_length(text) > 0).withColumn("src", F.col("row").getField("source"))
    if quality is not None:
        d = d.filter(w > 0)
    return d.withColumn("key", -F.ln(_uniform(F.col("rid"), seed)) / w)


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x00-\\x20]+")).cast("bigint")


def _plan(keyed: DataFrame, unit: str, weights: dict[str, int] | None, total_percent: int) -> tuple[DataFrame, DataFrame]:
    """((rid, doc_id, src, tokens, key), (psrc, epochs, last key and id selected beyond them) for each source)."""
    small_batches(keyed.sparkSession)
    row = F.col("row")
    slim = keyed.select("rid", row.getField("doc_id").cast("bigint").alias("doc_id"), "src", row.getField("text").alias("text"), "key")
    slim = slim.withColumn("tokens", _words(F.col("text"))).drop("text") if unit == "words" else counted(slim, "text", "tokens", unit)
    slim = written(slim, "mix-keys").filter("tokens > 0")
    slim = slim.withColumn("bin", F.floor(F.lit(BINS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int"))
    hist = written(slim.groupBy("src", "bin").agg(F.sum("tokens").alias("t")), "mix-bins")
    per = hist.groupBy("src").agg(F.sum("t").alias("have"))
    if weights is None:
        per = per.withColumn("weight", F.floor(F.sqrt(F.col("have").cast("double"))).cast("decimal(18,0)"))
    else:
        w = slim.sparkSession.createDataFrame([(k, int(v)) for k, v in weights.items()], "k string, weight bigint")
        per = per.join(w, F.col("src") == F.col("k"), "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("decimal(18,0)"))
    every = per.agg(F.sum("have").cast("decimal(19,0)").alias("a"), F.sum("weight").cast("decimal(19,0)").alias("b"))
    per = per.crossJoin(F.broadcast(every))  # one row
    budget = F.expr(f"CASE WHEN b > 0 THEN cast((a * {total_percent} div 100) * weight div b as bigint) ELSE 0L END")
    per = per.withColumn("budget", budget).withColumn("epochs", F.expr("budget div have")).withColumn("rest", F.expr("budget % have"))
    cum = hist.withColumn("before", F.sum("t").over(Window.partitionBy("src").orderBy("bin")) - F.col("t"))
    cum = cum.withColumnRenamed("src", "hsrc")
    hit = per.join(cum, F.col("src").eqNullSafe(F.col("hsrc"))).filter("before <= rest AND before + t > rest")
    cross = written(hit.select(F.col("src").alias("psrc"), "epochs", F.col("bin").alias("cross"), (F.col("rest") - F.col("before")).alias("need")), "mix-cross")
    at = slim.join(cross, F.col("src").eqNullSafe(F.col("psrc")) & (F.col("bin") == F.col("cross")))
    upto = F.sum("tokens").over(Window.partitionBy("psrc").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, 0))
    chosen = at.withColumn("upto", upto).filter("upto <= need").groupBy("psrc").agg(F.max(F.struct("key", "rid")).alias("last"))
    chosen = chosen.withColumnRenamed("psrc", "csrc")
    plan = cross.join(chosen, F.col("psrc").eqNullSafe(F.col("csrc")), "left").select("psrc", "epochs", "cross", "last")
    return slim, written(plan, "mix-plan")


def _copies(d: DataFrame, plan: DataFrame) -> DataFrame:
    """``d`` (src, key, rid, ...) with copies. The plan has a row a source; whether it is broadcast is left to its measured size."""
    d = d.join(plan, F.col("src").eqNullSafe(F.col("psrc")))
    bin_ = F.floor(F.lit(BINS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")
    more = (bin_ < F.col("cross")) | ((bin_ == F.col("cross")) & F.coalesce(F.struct("key", "rid") <= F.col("last"), F.lit(False)))
    return d.withColumn("copies", F.col("epochs") + more.cast("bigint")).filter("copies > 0")


def mix_plan(docs: DataFrame, weights: dict[str, int] | None = None, total_percent: int = 100, seed: int = SEED, unit: str = PATH, quality: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document that the mixture takes at least once.

    unit: the file of the tokenizer whose ids are counted, or "words". quality: the column of the documents' weights.
    """
    slim, plan = _plan(_keyed(docs, seed, quality), unit, weights, total_percent)
    return _copies(slim, plan).select("doc_id", F.col("src").alias("source"), F.col("tokens").alias("n_tokens"), "copies")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, total_percent: int = 100, seed: int = SEED, unit: str = PATH, quality: str | None = None) -> DataFrame:
    """``docs`` mixed: each taken document so many times as the mixture has copies of it, in its own columns."""
    keyed = _keyed(docs, seed, quality)
    _, plan = _plan(keyed, unit, weights, total_percent)
    if unit == "words":
        keyed = keyed.filter(_words(F.col("row").getField("text")) > 0)
    out = _copies(keyed, plan).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return unpacked(out, docs.columns)
