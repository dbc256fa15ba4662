"""A stored index of statements that a written batch is checked against.

What can conflict with a row is a small value (a number of an attribute, members
of an exclusive set) or a signature of the other polarity. The index keeps these
per concept, collapsed over rows of one time, in folders by hash; a batch reads
the folders of its own concepts, the distinct signatures and no text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as fx
from ..session import cut_lineage, save
from .conflicts import exclusive_statements, numeric_statements
from .temporal import as_of_chain

#: Folders per table. Fixed, so that batches written at different times share them.
BUCKETS = 64
#: Signatures conflict from this Jaccard similarity on.
OVERLAP = 0.5
#: A faded conflict below 0.1 does not count, so no two rows further apart than this can have one.
FADES_WITHIN = 9 * 86400.0
#: The most similar signature is looked for among those that reach the first of these, then the next.
LEVELS = [0.75, OVERLAP]
#: Over how many tasks a term is dealt that many statements of a concept hold.
SALTS = 8


#: Columns of the stored tables, named because a table without rows has no file to tell them.
TABLES = {
    "values": "concept string, slot string, number double, members string, created_at double, memory_id long, bucket int",
    "holders": "digest string, negated boolean, concept string, created_at double, memory_id long, bucket int",
    "signatures": "digest string, negated boolean, words array<string>, bucket int",
    "order": "term string, df long",
}


def _bucket(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many parts as the session shuffles to, however few bytes it has: what follows is work per row, not per byte."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _salts() -> Column:
    return F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))


def _of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass
class Statements:
    """What a set of memories states.

    ``values`` (memory_id, concept, created_at, slot, number, members): one row
    per attribute or exclusive set; ``signed`` (memory_id, concept, created_at,
    digest, negated); ``signatures`` (digest, negated, words), distinct.
    """

    values: DataFrame
    signed: DataFrame
    signatures: DataFrame


def read_statements(memories: DataFrame, bridge: DataFrame) -> Statements:
    """Statements of ``memories`` (memory_id, content, created_at) under their concepts (memory_id, concept).

    A null text states nothing; rows without a concept or a time are left out; a repeated bridge row counts once.
    """
    number = F.col("memory_id").cast("long").alias("memory_id")
    dated = memories.select(number, "content", F.col("created_at").cast("double").alias("created_at")).filter("created_at IS NOT NULL")
    dated = _dealt(dated)
    links = bridge.select(number, "concept").filter("concept IS NOT NULL").distinct()
    held = links.join(dated.select("memory_id", "created_at"), "memory_id")
    numbers = numeric_statements(dated).select(
        "memory_id", F.col("attribute").alias("slot"), F.col("value").alias("number"), F.lit(None).cast("string").alias("members")
    )
    sets = exclusive_statements(dated).select(
        "memory_id", F.concat(F.lit("set "), F.col("set_id").cast("string")).alias("slot"),
        F.lit(None).cast("double").alias("number"), F.array_join("members", " ").alias("members"),
    )
    sig = dated.select("memory_id", fx.polarity_signature(F.col("content")).alias("s")).select("memory_id", "s.*")
    sig = sig.filter(F.size("signature") > 0).withColumn("digest", F.sha2(F.array_join("signature", " "), 256))
    sig = cut_lineage(sig)
    return Statements(
        values=held.join(numbers.unionByName(sets), "memory_id"),
        signed=held.join(sig.select("memory_id", "digest", "negated"), "memory_id"),
        signatures=sig.groupBy("digest", "negated").agg(F.first("signature").alias("words")),
    )


def _ranked(signatures: DataFrame, order: DataFrame) -> DataFrame:
    """(digest, negated, words): the terms of each signature, rarest first by the stored order.

    Terms that the order does not know come first. Two signatures with a Jaccard similarity of t or more share one of the
    first ``size - ceil(size * t) + 1`` terms of each under any fixed order, so a stale order costs time and loses nothing.
    """
    terms = signatures.select("digest", "negated", F.explode("words").alias("term"))
    # A signature's own terms: bounded by its text.
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")))
    rows = terms.join(order, "term", "left").groupBy("digest", "negated").agg(ranked.alias("ranked"))
    return rows.select("digest", "negated", F.col("ranked.term").alias("words"))


def _by_term(rows: DataFrame, words: str, threshold: float) -> DataFrame:
    """``rows`` once per term that a set of ``threshold`` or more similarity shares with theirs."""
    length = (F.size(words) - F.ceil(F.size(words) * threshold - 1e-9) + 1).cast("int")
    return rows.withColumn("term", F.explode(F.slice(words, F.lit(1), length)))


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (words, rival_words) that reach the threshold, with their similarity."""
    mine, rival = F.size("words"), F.size("rival_words")
    close = pairs.filter((rival >= mine * threshold - 1e-9) & (mine >= rival * threshold - 1e-9))
    common = F.size(F.array_intersect("words", "rival_words"))
    return close.withColumn("similarity", common / (mine + rival - common)).filter(F.col("similarity") >= threshold)


class ConflictIndex:
    """Statements of a store under ``path``, in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, name: str, by: str, mode: str) -> None:
        # A concept or term that very many rows hold goes to several files of its folder.
        spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
        rows = df.withColumn("bucket", _bucket(by)).repartition("bucket", spread).sortWithinPartitions("bucket", by)
        rows.write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, name: str, keys: DataFrame, by: str) -> DataFrame:
        """Rows of a table in the folders of ``keys``; at most BUCKETS numbers come to the driver to prune them."""
        found = [r.bucket for r in keys.select(_bucket(by).alias("bucket")).distinct().collect()]
        return self._table(name).filter(F.col("bucket").isin(found)).drop("bucket")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def write(self, memories: DataFrame, bridge: DataFrame) -> None:
        """Write the index anew; the term order is taken from these rows."""
        stated = read_statements(memories, bridge)
        terms = stated.signatures.select(F.explode("words").alias("term"))
        terms.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{self.path}/order")
        self._store(stated, "overwrite")

    def append(self, memories: DataFrame, bridge: DataFrame) -> None:
        """Add a batch. The term order stays, so what earlier batches wrote stays valid."""
        self._store(read_statements(memories, bridge), "append")

    def _store(self, stated: Statements, mode: str) -> None:
        order = self._table("order")
        one = F.min("memory_id").alias("memory_id")
        self._write(stated.values.groupBy("concept", "slot", "number", "members", "created_at").agg(one), "values", "concept", mode)
        self._write(stated.signed.groupBy("digest", "negated", "concept", "created_at").agg(one), "holders", "concept", mode)
        self._write(_ranked(stated.signatures, order), "signatures", "digest", mode)

    def _rivals(self, signed: DataFrame) -> DataFrame:
        """(concept, negated, rival_words, created_at, rival): stored statements under the batch's concepts, ``negated`` as their opposite."""
        holders = self._read("holders", signed, "concept").join(signed.select("concept").distinct(), "concept", "left_semi")
        # Batches may have stored one signature several times.
        words = self._table("signatures").groupBy("digest").agg(F.first("words").alias("rival_words"))
        return holders.join(words, "digest").select(
            "concept", (~F.col("negated")).alias("negated"), "rival_words", "created_at", F.col("memory_id").alias("rival")
        )

    def check(self, batch: DataFrame, bridge: DataFrame) -> DataFrame:
        """(new_id, kind, rival_id, confidence): per batch row and kind its strongest conflict with a stored row.

        A stored row counts if it shares a concept with the batch row. Kinds are numeric_range, mutual_exclusion,
        polarity, and temporal_conflict, which is any of the three faded by the time between the two rows, and left out
        below 0.1. Ties go to the farther number, then to the smaller rival. Rows of the batch are not compared with one
        another, nor a row with its own id.
        """
        stated = read_statements(batch, bridge)
        values = save(stated.values, "values")
        signed = save(stated.signed.join(_ranked(stated.signatures, self._table("order")), ["digest", "negated"]), "signed")
        stored = save(self._read("values", values, "concept").join(values.select("concept", "slot").distinct(), ["concept", "slot"], "left_semi"), "stored")
        rivals = save(self._rivals(signed), "rivals")
        polar = save(_polarity(signed, rivals), "polar")
        faded = save(_faded_values(values, stored), "faded")
        found = _of([_numeric(values, stored), _exclusive(values, stored), polar, faded, _faded_polarity(signed, rivals, polar, faded)])
        best = F.struct("confidence", "distance", (-F.col("rival_id")).alias("first"))
        top = found.filter("rival_id <> new_id").groupBy("new_id", "kind").agg(F.max(best).alias("b"))
        return top.select("new_id", "kind", (-F.col("b.first")).alias("rival_id"), F.round("b.confidence", 6).alias("confidence"))


def _row(kind: str, rival: Column, confidence: Column, distance: Column | None = None) -> list[Column]:
    far = F.lit(0.0) if distance is None else distance
    return [F.col("memory_id").alias("new_id"), F.lit(kind).alias("kind"), rival.alias("rival_id"), confidence.alias("confidence"), far.alias("distance")]


def _numeric(values: DataFrame, stored: DataFrame) -> DataFrame:
    """The conflict of a number grows with distance on either side, so the extremes of a concept's attribute decide."""
    low, high = F.min(F.struct("number", "memory_id")), F.max(F.struct("number", (-F.col("memory_id")).alias("first")))
    ends = stored.filter("number IS NOT NULL").groupBy("concept", "slot").agg(low.alias("low"), high.alias("high"))
    sides = F.array(
        F.struct(F.col("low.number").alias("other"), F.col("low.memory_id").alias("rival")),
        F.struct(F.col("high.number").alias("other"), (-F.col("high.first")).alias("rival")),
    )
    met = values.filter("number IS NOT NULL").join(ends, ["concept", "slot"]).select("memory_id", "number", F.inline(sides))
    far = F.abs(F.col("number") - F.col("other"))
    return met.filter("number <> other").select(*_row("numeric_range", F.col("rival"), fx.numeric_conflict(F.col("number"), F.col("other")), far))


def _exclusive(values: DataFrame, stored: DataFrame) -> DataFrame:
    """A set of k members has at most 2^k - 1 stored classes per concept."""
    classes = stored.filter("members IS NOT NULL").groupBy("concept", "slot", F.col("members").alias("others")).agg(F.min("memory_id").alias("rival"))
    met = values.filter("members IS NOT NULL").join(classes, ["concept", "slot"]).filter("members <> others")
    return met.select(*_row("mutual_exclusion", F.col("rival"), F.lit(0.95)))


def _polarity(signed: DataFrame, rivals: DataFrame) -> DataFrame:
    """The most similar signature of the other polarity under each concept; equal signatures of a concept look for it once.

    A signature that finds a rival at a level needs no lower one, as every rival of that level is met there. What meets is
    compared and reduced where it meets, so what moves on is one row per signature and concept.
    """
    again = signed.select("memory_id").join(rivals.select(F.col("rival").alias("memory_id")), "memory_id", "left_semi").distinct()
    # A row whose id is stored may not meet itself, so it looks alone.
    asked = signed.join(again.withColumn("own", F.col("memory_id")), "memory_id", "left")
    asked = asked.withColumn("unit", F.sha2(F.concat_ws("\x00", "digest", F.col("negated").cast("string"), "concept", F.col("own").cast("string")), 256))
    asked = save(asked.select("memory_id", "unit", "own", "concept", "negated", "words"), "asked")
    open_ = save(asked.drop("memory_id").dropDuplicates(["unit"]), "units")
    classes = save(rivals.groupBy("concept", "negated", "rival_words").agg(F.min("rival").alias("rival")), "classes")
    keys = ["concept", "negated", "term", "salt"]
    best = []
    for level in LEVELS:
        mine = _by_term(open_.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(SALTS))), "words", level)
        theirs = _by_term(classes, "rival_words", level).withColumn("salt", _salts())
        met = _dealt(mine, *keys).join(_dealt(theirs, *keys), keys).filter("own IS NULL OR rival <> own")
        met = _similar(met, level)
        top = met.groupBy("unit").agg(F.max(F.struct("similarity", (-F.col("rival")).alias("first"))).alias("b"))
        best.append(save(top, "best"))
        open_ = open_.join(best[-1].select("unit"), "unit", "left_anti")
    return asked.join(_of(best), "unit").select(*_row("polarity", -F.col("b.first"), fx.polarity_conflict(F.col("b.similarity"))))


def _faded_values(values: DataFrame, stored: DataFrame) -> DataFrame:
    """Faded conflicts of numbers and exclusive sets, the strongest per row among the numbers and per class among the sets."""
    span = values.agg((F.min("created_at") - FADES_WITHIN).alias("since"), (F.max("created_at") + FADES_WITHIN).alias("until"))
    # One row; it prunes by time.
    near = stored.join(F.broadcast(span), F.col("created_at").between(F.col("since"), F.col("until"))).drop("since", "until")
    return _faded_numbers(values, near).unionByName(_faded_sets(values, near))


def _faded_numbers(values: DataFrame, near: DataFrame) -> DataFrame:
    """Of the numbers of one time the lowest or the highest conflicts most, so a row meets those of each time, never all numbers.

    Zero conflicts fully with every number from 1 on, of which the smallest id counts. The second of each kind stands in
    where the first is the row itself.
    """
    rows = near.filter("number IS NOT NULL").select("concept", "slot", F.col("created_at").alias("then"), "number", "memory_id")
    orders = {
        "low": F.struct(F.col("number").alias("by"), "memory_id", "number"),
        "high": F.struct((-F.col("number")).alias("by"), "memory_id", "number"),
        "any": F.when(F.col("number") >= 1, F.struct(F.col("memory_id").alias("by"), "memory_id", "number")),
    }
    first = rows.groupBy("concept", "slot", "then").agg(*[F.min(o).alias(k) for k, o in orders.items()])
    others = [F.min(F.when(F.col("memory_id") != F.col(f"{k}.memory_id"), o)).alias(f"{k}_2") for k, o in orders.items()]
    second = rows.join(first, ["concept", "slot", "then"]).groupBy("concept", "slot", "then").agg(*others)
    ends = save(first.join(second, ["concept", "slot", "then"]), "ends")
    mine = values.filter("number IS NOT NULL").select(
        F.col("memory_id").alias("new_id"), "concept", "slot", F.col("created_at").alias("now"), F.col("number").alias("own")
    )
    keys = ["concept", "slot", "salt"]
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("new_id"), F.lit(SALTS)))
    met = _dealt(mine, *keys).join(_dealt(ends.withColumn("salt", _salts()), *keys), keys).filter(F.abs(F.col("now") - F.col("then")) <= FADES_WITHIN)

    def rival(kind: str) -> Column:
        one = F.when(F.col(f"{kind}.memory_id") == F.col("new_id"), F.col(f"{kind}_2")).otherwise(F.col(kind))
        one = one if kind != "any" else F.when(F.col("own") == 0, one)
        conf = F.when(one["number"] != F.col("own"), fx.numeric_conflict(F.col("own"), one["number"]))
        faded = fx.faded_conflict(conf, F.col("now"), F.col("then"))
        return F.when(faded.isNotNull(), F.struct(faded.alias("confidence"), (-one["memory_id"]).alias("first")))

    top = met.groupBy("new_id").agg(F.max(F.greatest(*[rival(k) for k in orders])).alias("b")).filter("b IS NOT NULL")
    return top.select(F.col("new_id").alias("memory_id"), "b").select(*_row("temporal_conflict", -F.col("b.first"), F.col("b.confidence")))


def _faded_sets(values: DataFrame, near: DataFrame) -> DataFrame:
    """Of one class of rivals the nearest in time fades least; it is looked up before and after the row's time."""
    chain = F.sha2(F.concat_ws("\x00", "concept", "slot", "others"), 256).alias("chain_id")
    held = save(near.filter("members IS NOT NULL").withColumnRenamed("members", "others").select(chain, "concept", "slot", "others", "created_at", "memory_id"), "held")
    classes = held.select("chain_id", "concept", "slot", "others").distinct()
    moments = values.filter("members IS NOT NULL").join(classes, ["concept", "slot"]).filter("members <> others")
    moments = save(moments.select(F.col("memory_id").alias("new_id"), F.col("created_at").alias("now"), "chain_id").distinct(), "moments")
    times = save(held.groupBy("chain_id", "created_at").agg(F.min("memory_id").alias("memory_id")), "times")

    def nearest(sign: int) -> DataFrame:
        versions = times.select("chain_id", "memory_id", (F.col("created_at") * sign).alias("created_at"))
        versions = versions.withColumn("version", F.col("created_at"))
        return as_of_chain(versions, moments.withColumn("at", F.col("now") * sign), 86400.0).withColumn("then", F.col("version") * sign)

    met = nearest(1).unionByName(nearest(-1)).filter("memory_id IS NOT NULL")
    faded = met.withColumn("confidence", fx.faded_conflict(F.lit(0.95), F.col("now"), F.col("then"))).filter("confidence IS NOT NULL")
    return faded.select(F.col("memory_id").alias("rival"), F.col("new_id").alias("memory_id"), "confidence").select(
        *_row("temporal_conflict", F.col("rival"), F.col("confidence"))
    )


def _faded_polarity(signed: DataFrame, rivals: DataFrame, polar: DataFrame, faded: DataFrame) -> DataFrame:
    """Faded conflicts of polarity, for the rows where one may be stronger than what their values gave.

    None is stronger than the row's strongest conflict of polarity, and with that one's strength it has to lie near enough in
    time to come up to the faded conflict that the row has already.
    """
    have = faded.filter("rival_id <> new_id").groupBy("new_id").agg(F.max("confidence").alias("have"))
    most = polar.groupBy("new_id").agg(F.max("confidence").alias("most")).join(have, "new_id", "left")
    # What rounding may hide is searched as well.
    reach = (F.col("most") / F.coalesce(F.greatest("have", F.lit(0.1)), F.lit(0.1)) - 1 + 1e-9) * 86400.0
    open_ = most.select(F.col("new_id").alias("memory_id"), reach.alias("reach")).filter("reach >= 0")
    keys = ["concept", "negated", "term", "salt"]
    mine = signed.join(open_, "memory_id").select("memory_id", "concept", "negated", "words", F.col("created_at").alias("now"), "reach")
    mine = save(mine, "open")
    theirs = rivals.join(mine.select("concept").distinct(), "concept", "left_semi").withColumn("salt", F.pmod(F.col("rival"), F.lit(SALTS)))
    mine = _by_term(mine, "words", OVERLAP).withColumn("salt", _salts())
    met = _dealt(mine, *keys).join(_dealt(_by_term(theirs, "rival_words", OVERLAP), *keys), keys)
    met = _similar(met.filter((F.abs(F.col("now") - F.col("created_at")) <= F.col("reach")) & (F.col("rival") != F.col("memory_id"))), OVERLAP)
    conf = fx.faded_conflict(fx.polarity_conflict(F.col("similarity")), F.col("now"), F.col("created_at"))
    top = met.withColumn("confidence", conf).filter("confidence IS NOT NULL").groupBy("memory_id").agg(
        F.max(F.struct("confidence", (-F.col("rival")).alias("first"))).alias("b")
    )
    return top.select(*_row("temporal_conflict", -F.col("b.first"), F.col("b.confidence")))
