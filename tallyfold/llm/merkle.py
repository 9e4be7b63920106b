"""Merkle manifest of a dataset: a tree of hashes per group, a tree over the groups' roots,
and a proof for every record.

The levels are built bottom-up and written as node rows, each with its children's digests and
a link to its parent. A recursive query then climbs from every run of leaves to the root: at
each step it appends the siblings and folds the hashes that it carries. The leaves of a run
have everything above the run in common, so they climb in one row, which holds the hash of
the run and one more for each leaf that was tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.skew import lookup_join, running_sums
from tallyfold.sources.shared import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
DIGEST = 32
#: Number of the tree over the groups' roots.
TOP = -1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(data: Column) -> Column:
    """The 32 bytes of the sha256."""
    return F.unhex(F.sha2(data, 256))


def as_text(digests: Column) -> Column:
    """Digests as lower-case hex text; of joined digests, the joined texts."""
    return F.lower(F.hex(digests))


def record_hash(fields: Sequence[Column]) -> Column:
    """Hash of a record: each field is ``-`` if null, else byte count, ``:``, value."""
    said = []
    for field in fields:
        value = field.cast("string")
        told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        said.append(F.coalesce(told, F.lit("-")))
    return sha(F.concat(*said))


def chosen_for_tampering(key: Column) -> Column:
    """True where 5 divides the crc32 of the decimal key; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _node(tree: Column, level: Column, idx: Column) -> Column:
    return F.concat_ws("/", tree, level, idx)


def _linked(nodes: DataFrame, n_groups: int) -> DataFrame:
    """Add (node, up, place): the node's name, its parent's and its place there. ``n`` is the
    number of nodes on its level of its tree. Only the root has no parent."""
    tree, level, idx = F.col("tree"), F.col("level"), F.col("idx")
    inside = F.col("n") > 1
    leads = (tree != TOP) & F.lit(n_groups > 1)
    above = F.when(inside, _node(tree, level + 1, F.floor(idx / ARITY)))
    above = above.when(leads, _node(F.lit(TOP), F.lit(1), F.floor(tree / ARITY)))
    return nodes.select(
        "*",
        _node(tree, level, idx).alias("node"),
        above.alias("up"),
        F.when(inside, idx % ARITY).when(leads, tree % ARITY).cast("int").alias("place"),
    )


def _next_level(nodes: DataFrame) -> DataFrame:
    """Each run of ARITY nodes of (tree, level, idx, digest, n) becomes a node with their
    digests joined in ``children``."""
    run = F.floor(F.col("idx") / ARITY)
    joined = F.aggregate(
        F.array_sort("members"), F.lit(b""), lambda a, m: F.concat(a, m["digest"])
    )
    return (
        nodes.filter("n > 1")
        .groupBy("tree", "level", run.alias("run"))
        .agg(F.collect_list(F.struct("idx", "digest")).alias("members"), F.max("n").alias("n"))
        .select(
            "tree",
            (F.col("level") + 1).alias("level"),
            F.col("run").alias("idx"),
            joined.alias("children"),
            F.ceil(F.col("n") / ARITY).alias("n"),
        )
        .withColumn("digest", sha(as_text(F.col("children"))))
    )


def _levels_above(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above one of at most ``most`` nodes a tree, each written."""
    levels = []
    while most > 1:
        nodes = settle(_next_level(nodes))
        levels.append(nodes)
        most = -(-most // ARITY)
    return levels


@contextmanager
def _unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a number of rows by default; levels stay bounded."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# The digests to the left and to the right of a node among its parent's children.
_LEFT = f"substring(n.children, 1, {DIGEST} * c.place)"
_RIGHT = f"substring(n.children, {DIGEST} * c.place + {DIGEST + 1})"
CLIMB = f"""
with recursive climb(run, up, place, digest, subroot, proof, folded) as (
  select node, up, place, digest, cast(null as binary), cast('' as binary), folded from {{start}}
  union all
  select /*+ shuffle_hash(n) */ c.run, n.up, n.place, n.digest,
    case when n.top then coalesce(c.subroot, c.digest) end,
    concat(c.proof, {_LEFT}, {_RIGHT}),
    transform(c.folded, f -> unhex(sha2(lower(hex(concat({_LEFT}, f, {_RIGHT}))), 256)))
  from climb c join {{nodes}} n on n.node = c.up
)
select run, digest as root, coalesce(subroot, digest) as subroot, proof, folded
from climb where up is null
"""


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    text: str = "text",
) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Leaves of a group ascend by (key, digest), a null key first; groups ascend bytewise, the
    null group first. Equal rows are leaves of their own, one beside the other; which of them
    has which place doesn't matter. A null field is told apart from an empty one. A lone leaf
    is its group's root, a lone group's root the root; a proof without siblings is the hash of
    nothing. An empty table gives no rows. Other columns are neither hashed nor returned.

    ``folded_root`` climbs from the record as it is found later: the text in lower case (A-Z)
    where ``chosen_for_tampering``. ``verified`` says that it leads to the root.

    Only digests are shuffled, in ranges of (group, key, digest); no task holds a group. A
    node has at most ARITY children.
    """
    given = [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    names = [f"f{i}" for i in range(len(fields))]
    at = {f: n for f, n in zip(fields, names)}
    rows = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("g"), *given)
    lowered = F.translate(F.col(at[text]), UPPER, UPPER.lower())
    found = [lowered if n == at[text] else F.col(n) for n in names]
    # 's' before a name keeps the null group ('') first and apart from the empty name
    leaves = rows.select(
        "key",
        F.when(F.col("g").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("g"))).alias("grp"),
        record_hash([F.col(n) for n in names]).alias("leaf"),
        F.when(
            chosen_for_tampering(F.col("key")) & (lowered != F.col(at[text])), record_hash(found)
        ).alias("altered"),
        F.monotonically_increasing_id().alias("seq"),
    )
    leaves = settle(leaves)
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    groups = running_sums(sizes, [], ["grp"], {"tree": F.lit(1)}).withColumn("tree", F.col("tree") - 1)
    groups = settle(groups.withColumn("n_rows", F.col("n")))
    seen = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()

    # runs of leaves: one row each, with its members in order
    ranked = running_sums(leaves, ["grp"], ["key", "leaf", "seq"], {"idx": F.lit(1)})
    member = F.struct(F.col("idx"), F.col("key"), F.col("leaf"), F.col("altered"))
    runs = ranked.groupBy("grp", F.floor((F.col("idx") - 1) / ARITY).alias("run")).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    )
    runs = lookup_join(runs, groups, ["grp"], ["run"])
    children = F.aggregate("members", F.lit(b""), lambda a, m: F.concat(a, m["leaf"]))
    runs = runs.select(
        "tree", F.col("run").alias("idx"), F.col("n").alias("n_leaves"), "members", children.alias("children")
    )
    lone = F.col("n_leaves") == 1
    runs = runs.select(
        "*",
        F.when(lone, F.lit(0)).otherwise(F.lit(1)).alias("level"),
        F.when(lone, F.lit(1)).otherwise(F.ceil(F.col("n_leaves") / ARITY)).cast("bigint").alias("n"),
        F.when(lone, F.col("children")).otherwise(sha(as_text(F.col("children")))).alias("digest"),
    )
    runs = settle(_linked(runs, seen["groups"]))

    most = -(-(seen["most"] or 0) // ARITY)
    columns = ["tree", "level", "idx", "children", "n", "digest"]
    below = [runs.select(*columns), *_levels_above(runs.select(*columns), most)]
    tips = reduce(DataFrame.unionByName, below).filter("n = 1")
    top = tips.select(
        F.lit(TOP).cast("bigint").alias("tree"),
        F.lit(0).alias("level"),
        F.col("tree").alias("idx"),
        "digest",
        F.lit(seen["groups"]).cast("bigint").alias("n"),
    )
    above = [*below[1:], *_levels_above(top, seen["groups"])]
    if above:
        nodes = reduce(DataFrame.unionByName, above)
    else:
        nodes = runs.select(*columns).limit(0)
    nodes = settle(
        _linked(nodes, seen["groups"]).select(
            "node", "up", "place", "children", "digest", (F.col("tree") == TOP).alias("top")
        )
    )

    def swapped(m: Column) -> Column:
        """The run's children with those of one leaf altered."""
        place = ((m["idx"] - 1) % ARITY).cast("int")
        left = F.substring(F.col("children"), F.lit(1), place * DIGEST)
        right = F.substring(F.col("children"), place * DIGEST + DIGEST + 1, F.lit(ARITY * DIGEST))
        return F.concat(left, m["altered"], right)

    altered = F.filter("members", lambda m: m["altered"].isNotNull())
    tried = F.transform(
        altered,
        lambda m: F.when(F.col("level") == 0, m["altered"]).otherwise(sha(as_text(swapped(m)))),
    )
    start = runs.select("node", "up", "place", "digest", F.concat(F.array("digest"), tried).alias("folded"))
    with _unlimited_rows(docs.sparkSession):
        climbed = settle(docs.sparkSession.sql(CLIMB, start=start, nodes=nodes))

    whole = runs.join(climbed, runs["node"] == climbed["run"]).select(
        "members", "children", climbed["root"], climbed["subroot"], "proof", "folded",
    )
    # the number of the folded hash that a member's is: 0 for the unaltered
    slot = F.when(F.col("m.altered").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("members", lambda m: m["altered"].isNotNull() & (m["idx"] <= F.col("m.idx"))))
    )
    place = ((F.col("m.idx") - 1) % ARITY).cast("int")
    siblings = F.concat(
        F.substring("children", F.lit(1), place * DIGEST),
        F.substring("children", place * DIGEST + DIGEST + 1, F.lit(ARITY * DIGEST)),
        F.col("proof"),
    )
    told = whole.withColumn("m", F.explode("members")).select(
        F.col("m.key").alias(key),
        as_text(F.col("m.leaf")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        as_text(F.col("root")).alias("root"),
        F.sha2(as_text(siblings), 256).alias("proof_sha256"),
        as_text(F.get("folded", slot)).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
