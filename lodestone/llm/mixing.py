"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same number of copies to begin with, target / source size, whose fraction has to be
rounded. Documents of a source are paired: word mass moves between the two fractions, at random in one of two
directions chosen so that expectations stay, until one of them is 0 or 1; it is settled, and the other goes on to the
next pair. As the mass that moves is counted in words, a source's words stay exactly at its target until one fraction
is left, so the mix ends within one document of the target.

The pairs form a reduction tree. Its first block are the documents of over 1 / ``HEAVY`` of their source (fewer than
``HEAVY`` each): what they leave open is paired with all other documents of the source taken as one, whose fractions rise
or fall in proportion, so that none leaves 0 to 1 and expectations stay. The others then make blocks of about ``BLOCK``,
dealt by a hash; each is folded on its own and leaves one open document for the next level's blocks. A source that holds a
third of all rows is thousands of blocks. All of it is DataFrame functions; the random numbers are hashes of ids, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, small, written

BLOCK = 64
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents of more than 1 / HEAVY of their source are the tree's first block.
HEAVY = 100
#: Fractions nearer to 0 or 1 than this are integral.
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """0-based rank of each source by code point, null last, without bringing all of them into one task."""
    spark = sources.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked")
    # one row for each partition: their number is the bound
    sizes = dealt.groupBy("part").count().withColumn("one", F.lit(1))
    before = sizes.select("part", (F.sum("count").over(Window.partitionBy("one").orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", place).join(before, "part").select(*sources.columns, (F.col("before") + F.col("place") - 1).alias("rank"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last, and share ``share`` of all sizes.

    A target stops at ``most`` times its source's size; the excess is shared anew by weight until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = written(_ranked(sources).select("source", "source_size", weight.alias("weight")), "weights")
    capped = F.lit(False)
    rate, stopped = None, -1
    while True:
        row = s.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(capped).alias("stopped"),
        ).first()
        if row["stopped"] == stopped:
            break
        stopped = row["stopped"]
        rate = (share * (row["all"] or 0) - row["fixed"]) / row["open"] if row["open"] else 0.0
        # those that stopped stay stopped: the rate only rises as their excess is shared out
        capped = F.col("weight") * rate >= most * F.col("source_size") if row["open"] else F.lit(True)
    return s.select("source", "source_size", F.when(capped, most * F.col("source_size")).otherwise(F.col("weight") * rate).alias("target"))


def _uniform(*parts: Column | str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


_ROW = "struct<size:bigint,id:bigint,nth:bigint,p:double>"


def _settled(row: Column, p: Column) -> Column:
    return F.struct(row["size"].alias("size"), row["id"].alias("id"), row["nth"].alias("nth"), p.alias("p"))


def _fold(rows: Column, seed: int) -> Column:
    """Pair the rows one after another: {open: the row left over, done: the rows whose p has become 0 or 1}."""
    start = F.struct(F.lit(None).cast(_ROW).alias("open"), F.array().cast(f"array<{_ROW}>").alias("done"))

    def step(state: Column, b: Column) -> Column:
        a = state["open"]
        up_a = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that a can take from b
        up_b = F.least((1 - b["p"]) * b["size"], a["p"] * a["size"])
        to_a = _uniform(F.lit(seed), a["id"], a["nth"], b["id"], b["nth"]) * (up_a + up_b) < up_b
        moved = F.when(to_a, up_a).otherwise(-up_b)
        p, q = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        first = (p < EPS) | (p > 1 - EPS)
        settled = F.when(first, _settled(a, F.round(p))).otherwise(_settled(b, F.round(q)))
        other = F.when(first, _settled(b, q)).otherwise(_settled(a, p))
        paired = F.struct(other.alias("open"), F.concat(state["done"], F.array(settled)).alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("open"), state["done"].alias("done"))).otherwise(paired)

    return F.aggregate(rows, start, step)


def round_fractions(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Settle p of every row (part, id, nth, size > 0, 0 < p < 1) to 0 or 1, keeping sum(size * p) of each part to one row.

    A part's last open row is rounded at random with its p.
    """
    done, level, now = [], 0, rows
    while True:
        now = written(now, f"level-{level}")
        counts = written(now.groupBy("part").agg(F.count("*").alias("n")), "counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            last = now.withColumn("p", (_uniform(F.lit(seed), F.lit(level), "id", "nth") < F.col("p")).cast("double"))
            done.append(last.select("part", "id", "nth", "size", "p"))
            break
        c = small(counts)
        x = now.join(c, now.part.eqNullSafe(c.part)).drop(c.part)
        dealt = x.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id", "nth"), F.ceil(F.col("n") / block)))
        # the longest come first: what is open at the end is then a short document, and the mix near its target
        grouped = dealt.groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct("size", "id", "nth", "p")), asc=False).alias("rows"))
        folded = written(grouped.select("part", _fold(F.col("rows"), seed * 1000 + level).alias("f")), f"folded-{level}")
        done.append(folded.select("part", F.explode("f.done").alias("d")).select("part", "d.*"))
        now = folded.select("part", "f.open.*")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _first_block(rows: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """The heavy rows of each part folded, and what they leave open paired with the part's other rows as one.

    ``pool`` has part, mass (sum of size * p) and room (sum of size * (1 - p)). Returns part, done (the heavy rows, all
    settled) and how much of its mass, or of its room, the pool has lost: down, up.
    """
    f = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("size", "id", "nth", "p")), asc=False).alias("rows"))
    f = written(f.select("part", _fold(F.col("rows"), seed).alias("f")), "first-block").alias("f")
    q = pool.alias("q")
    x = f.join(q, F.col("f.part").eqNullSafe(F.col("q.part")), "left").select("f.part", "f.f", *(F.coalesce(f"q.{c}", F.lit(0.0)).alias(c) for c in ("mass", "room")))
    a = F.col("f.open")
    gain, loss = F.least((1 - a["p"]) * a["size"], F.col("mass")), F.least(a["p"] * a["size"], F.col("room"))
    x = x.withColumns({"gain": gain, "loss": loss}).withColumn("to_a", _uniform(F.lit(seed + 7), a["id"], a["nth"]) * (F.col("gain") + F.col("loss")) < F.col("loss"))
    p = a["p"] + F.when(F.col("to_a"), F.col("gain")).otherwise(-F.col("loss")) / a["size"]
    # still open only if the pool has nothing more to give or take
    last = F.when((p < EPS) | (p > 1 - EPS), F.round(p)).otherwise((_uniform(F.lit(seed + 8), a["id"], a["nth"]) < p).cast("double"))
    share = lambda moved, whole: F.when(F.col(whole) > 0, F.least(F.col(moved) / F.col(whole), F.lit(1.0))).otherwise(0.0)
    down, up = F.when(F.col("to_a"), share("gain", "mass")).otherwise(0.0), F.when(F.col("to_a"), 0.0).otherwise(share("loss", "room"))
    return x.select("part", F.concat(F.col("f.done"), F.array(_settled(a, last))).alias("done"), down.alias("down"), up.alias("up"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Tell rows of one part, id, nth and size apart: all but one get another nth.

    They are numbered in each file's part and then across parts, so that no task has all of a thousand million equal rows.
    Equal rows are interchangeable: whichever gets which number, the result has the same rows.
    """
    key = ["part", "id", "nth", "size"]
    dealt = written(rows.withColumn("task", F.spark_partition_id()), "equal-rows")
    hashed = dealt.withColumn("key", F.xxhash64(*key))
    within = F.row_number().over(Window.partitionBy("key", *key, "task").orderBy("size"))
    counts = hashed.groupBy("key", *key, "task").count()  # a row for each task at most
    before = F.sum("count").over(Window.partitionBy("key", *key).orderBy("task")) - F.col("count")
    places = small(written(counts.select(*key, "task", before.alias("before")).where("before > 0"), "equal-places")).alias("b")
    n = hashed.withColumn("within", within).drop("key").alias("a")
    same = F.lit(True)
    for c in (*key, "task"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    again = F.col("a.within") + F.coalesce("b.before", F.lit(0))
    x = n.join(places, same, "left")
    return x.select(*(F.when(again > 1, F.xxhash64("a.nth", again)).otherwise(F.col("a.nth")).alias("nth") if c == "nth" else F.col(f"a.{c}") for c in rows.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    One row for each row of ``docs``. A size is a number of words; null and empty texts have 0, are taken with the
    whole part of their source's rate, and add nothing. The null source is a source of its own, the last. Rows with null
    or repeated ids are documents of their own, told apart by a hash of their text and, if that is equal too, by a number.
    An empty table gives an empty one. Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("part"), word_count(text).alias("size"), F.xxhash64(text).alias("nth"))
    sized = written(sized, "sized")
    wanted = targets(sized.groupBy(F.col("part").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("whole", F.floor(rate + EPS).cast("long")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    t = small(written(wanted, "targets"))
    x = sized.join(t, sized.part.eqNullSafe(t.source))
    settled = (F.col("p") < EPS) | (F.col("size") == 0)
    rows = x.where(~settled).select("part", "id", "nth", "size", "p", (F.col("size") * HEAVY > F.col("source_size")).alias("heavy"))
    if not rows.groupBy("part", "id", "nth").count().where("count > 1").isEmpty():
        rows = _numbered(rows)
    rows = written(rows, "open")
    done = x.where(settled).select("part", "size", "id", F.lit(0.0).alias("more"))

    pool = written(rows.where(~F.col("heavy")).groupBy("part").agg(F.sum(F.col("size") * F.col("p")).alias("mass"), F.sum(F.col("size") * (1 - F.col("p"))).alias("room")), "pool")
    first = written(_first_block(rows.where("heavy"), pool, seed + 1), "heavy")
    done = done.unionByName(first.select("part", F.explode("done").alias("d")).select("part", "d.size", "d.id", F.col("d.p").alias("more")))
    shift = small(first.select("part", "down", "up"))
    light = rows.where(~F.col("heavy"))
    light = light.join(shift, light.part.eqNullSafe(shift.part), "left").drop(shift.part)
    p = F.col("p") * (1 - F.coalesce("down", F.lit(0.0)))
    light = written(light.select("part", "id", "nth", "size", (p + (1 - p) * F.coalesce("up", F.lit(0.0))).alias("p")), "light")
    integral = (F.col("p") < EPS) | (F.col("p") > 1 - EPS)
    done = done.unionByName(light.where(integral).select("part", "size", "id", F.round("p").alias("more")))
    done = done.unionByName(round_fractions(light.where(~integral), seed).select("part", "size", "id", F.col("p").alias("more")))
    # what else there is to tell is the source's
    out = done.join(t, done.part.eqNullSafe(t.source)).withColumn("copies", F.col("whole") + F.round("more").cast("long"))
    return out.select(F.col("id").alias("doc_id"), F.col("part").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
