"""Helpers that several operators share: scratch tables, bucket linking and connected components.

Everything here is DataFrame code. Only schemas and emptiness tests reach the driver.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of up to this many members are compared pair by pair; larger ones with some leaders at a time.
PAIRWISE_MEMBERS = 24
LEADERS = 64
#: Buckets with up to this many members left end with a comparison of all that are still apart.
FINISH_MEMBERS = 256
#: Graphs of up to this many edges (16 bytes each) are contracted in one task, where no step needs an exchange.
ONE_TASK_EDGES = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
    spark.conf.set("spark.checkpoint.dir", root)
    atexit.register(_delete, root)
    return root


def _delete(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/sedimenta-{what}-{uuid.uuid4().hex}"


_LOCAL = threading.local()


def _open() -> list[dict[str, DataFrame]]:
    """The tables of each tidy() block that this thread is in."""
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sedimenta_path = path
    if _open():
        _open()[-1][path] = out
    return out


def drop(*tables: DataFrame | None) -> None:
    """Free the disk of tables that cut() wrote and that nothing reads any more, through the file system of the folder."""
    for t in tables:
        path = getattr(t, "_sedimenta_path", None)
        if path:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            for own in _open():
                own.pop(path, None)


@contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drop the tables cut inside once the block ends, by an error too; what is handed to the given function passes to the block around."""
    own: dict[str, DataFrame] = {}

    def keep(df: DataFrame) -> DataFrame:
        path = df._sedimenta_path
        own.pop(path, None)
        if len(_open()) > 1:
            _open()[-2][path] = df
        return df

    _open().append(own)
    try:
        yield keep
    finally:
        _open().pop()
        drop(*list(own.values()))


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each Spark context."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_sedimenta_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sedimenta-code-")) / "sedimenta_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._sedimenta_shipped = True


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def _stirred(c):
    """A bijection of longs (three xorshift steps): a new order of the nodes, so that no numbering makes contraction slow."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a long, b long): one row (id, root) for each node of an edge.

    Each round every node hooks to the least node among itself and its neighbours, edges are relabelled and
    self-loops go, until no edge is left; the nodes are renumbered between rounds, so the number of rounds is
    logarithmic whatever the ids; small graphs follow four hooks at a time. Joins are between written tables, where Spark can split a hub's rows; once the edges
    left are ONE_TASK_EDGES or fewer they are read as one partition. Null ends and loops are ignored. No edges: no rows.
    """
    with tidy() as keep:
        return keep(_contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = cut(ends, "edges"), None
    n = left.count()
    few_labels = n <= ONE_TASK_EDGES
    while n or labels is None:
        left, few = (left.coalesce(1), True) if n <= ONE_TASK_EDGES else (left, False)
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        if few:
            hook = hook.coalesce(1)
            for _ in range(2):
                far = hook.select(F.col("node").alias("mid"), F.col("parent").alias("far"))
                hook = hook.join(far, hook["parent"] == far["mid"], "left").select("node", F.coalesce("far", "parent").alias("parent"))
        hook = cut(hook, "hooks")
        hook = hook.coalesce(1) if few else hook
        if labels is None:
            labels = hook.select(F.col("node").alias("id"), F.col("parent").alias("root"))
        else:
            labels = labels.coalesce(1) if few_labels else labels
            labels = cut(labels.join(hook, labels["root"] == hook["node"], "left").select("id", F.coalesce("parent", "root").alias("root")), "labels")
        pa, pb = (hook.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in "ab")
        moved = left.join(pa, "a").join(pb, "b").where("pa <> pb").select(_stirred(F.col("pa")).alias("a"), _stirred(F.col("pb")).alias("b"))
        left = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        n = left.count()
        if n:
            labels = labels.select("id", _stirred(F.col("root")).alias("root"))
    return cut(labels, "labels")


def by_least(labels: DataFrame) -> DataFrame:
    """The labels with the least id of each component for its root."""
    least = labels.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("least"))
    return labels.join(least, labels["root"] == least["_root"]).select("id", F.col("least").alias("root"))


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels (id, root) once the links (a, b) of more are added; only roots that they join are contracted. Roots are the least ids."""
    for x in "ab":
        own = labels.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
        more = more.join(own, x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    more = cut(more.select("a", "b", "ra", "rb"), "roots")
    moved = by_least(components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b")))).select(F.col("id").alias("old"), F.col("root").alias("new"))
    ends = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    fresh = ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("root"))
    every = labels.unionByName(fresh)
    return every.join(moved, every["root"] == moved["old"], "left").select("id", F.coalesce("new", "root").alias("root"))


def within(a: str, b: str, tau: int):
    """Whether two columns of fingerprints differ in tau bits or fewer."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau


def _crowded(members: DataFrame, near: Callable, pairwise: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b) of small buckets, and the rows (key, id, fp, n, lo) of large ones, if there are any."""
    sizes = cut(members.groupBy("key").agg(F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1 and lo <> hi"), "buckets")
    rows = cut(members.join(sizes.select("key", "n", "lo"), "key").select("key", "id", "fp", "n", "lo"), "members")
    few = rows.where(F.col("n") <= pairwise)
    own = [few.select("key", F.col("id").alias(x), F.col("fp").alias(f"f{x}")) for x in "ab"]
    pairs = own[0].join(own[1].withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & near("fa", "fb")).select("a", "b")
    large = rows.where(F.col("n") > pairwise)
    return pairs, None if large.isEmpty() else large


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], tau: int, pairwise: int = PAIRWISE_MEMBERS, near: Callable | None = None) -> DataFrame:
    """Components of the graph whose links are pairs that share a bucket and pass a test.

    members: (key long, id long, fp long), where fp is the id's fingerprint; pairs whose fingerprints differ in more than
    tau bits may be left out; with near, which tells by the names of two columns of fp whether a pair is to be tested, fp may be of
    any type. verify takes and returns pairs (a, b) and makes the whole test. Buckets of up to
    pairwise members are compared pair by pair: each id with the least of its candidates first, then what is still apart.
    The result (id, root) has a row for each linked id. It equals the components of all verified pairs of all
    buckets, but never lists the pairs of a large bucket: its members are compared with its first, then with the first
    member of each of its components (of up to LEADERS, if more than FINISH_MEMBERS are left) unless they are in it
    already; these leaders have then met all others and leave. What is left of a bucket of up to FINISH_MEMBERS is
    compared pair by pair across components after that; a larger one takes more rounds, each with twice as many leaders. A bucket is done when one
    component is left. So a bucket of n near copies costs n tests.
    """
    with tidy() as keep:
        return keep(_linked(members, verify, near or (lambda a, b: within(a, b, tau)), pairwise))


def _linked(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable, pairwise: int) -> DataFrame:
    with tidy() as keep:
        pairs, large = _crowded(members, near, pairwise)
        if large is not None:
            lo = large.where("id = lo").select("key", "lo", F.col("fp").alias("lo_fp"))
            large = keep(cut(large.where("id <> lo").select("key", "id", "fp"), "large"))
            pairs = pairs.unionByName(large.join(lo, "key").where(near("fp", "lo_fp")).select(F.col("lo").alias("a"), F.col("id").alias("b")))
        pairs = keep(cut(pairs.distinct(), "pairs"))
    with tidy() as keep:
        links = keep(cut(verify(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "links"))
    labels = cut(by_least(components(links)), "labels")
    with tidy() as keep:
        ends = [labels.select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
        apart = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        first = pairs.groupBy("b").agg(F.min("a").alias("a"))
        more = cut(verify(apart.join(first, ["a", "b"], "left_anti")), "links")
        if not more.isEmpty():
            labels = keep(cut(joined(labels, more), "labels"))
    last, leaders = False, LEADERS
    while large is not None and not large.isEmpty():
        with tidy() as keep:
            own = cut(large.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")), "large")
            mixed = own.groupBy("key").agg(F.count("id").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key", "m")
            apart = cut(own.join(mixed, "key"), "apart")
            if apart.isEmpty():
                break
            few = F.col("m") <= FINISH_MEMBERS
            heads = apart.groupBy("key", "root", "m").agg(F.min(F.struct("id", "fp")).alias("x")).select("key", "root", "m", "x.*")
            turn = F.row_number().over(W.partitionBy("key").orderBy("id"))
            many = heads.where(~few).withColumn("turn", turn).where(F.col("turn") <= leaders)
            lead = ["key", F.col("root").alias("lead_root"), F.col("id").alias("lead"), F.col("fp").alias("lead_fp")]
            leads = cut((apart if last else heads).where(few).select(*lead).unionByName(many.select(*lead)), "leads")
            cross = apart.join(leads, "key").where((F.col("root") != F.col("lead_root")) & near("fp", "lead_fp")).select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
            more = cut(verify(cross.distinct()), "links")
            if not more.isEmpty():
                labels = keep(cut(joined(labels, more), "labels"))
            done = leads.select("key", F.col("lead").alias("id"))
            large = keep(cut(apart.select("key", "id", "fp").join(done, ["key", "id"], "left_anti"), "members"))
        last, leaders = True, 2 * leaders
    return cut(labels, "labels")
