"""Merkle manifest of a dataset, by concatenated-level strings.

Every row is a leaf: the sha256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Leaves
of a group (a language) ascend by id; every 8 consecutive digests become the sha256 of their hex texts, until one is left.
The groups' subroots, nulls first and then bytewise, become the root in the same way.

An aligned block of 8**3 nodes is one row that keeps each of its levels as one hex string: parents are the hashes of
512-character substrings, and the siblings of a node are the substrings of its run before and after it. The blocks' last
digests are the nodes of the next, 512 times smaller, round. Proofs come back down the same rounds: the steps of a node
are its own flanks followed by those of its block.

Texts are hashed where they are read; ids and digests alone are shuffled, and no task holds more than a block.

Null fields hash as ``-``; a null id sorts first and is never tampered with; the empty text hashes as ``0:``. Rows of one id ascend by
leaf, and rows repeated whole are one leaf each, in any order, which gives the same rows. An empty table gives an empty
result. Further columns are left out and may clash in name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import fold, stage, table
from countwatch.llm.ordering import in_order, pick, places, same
from countwatch.llm.sqltext import crc32

FAN = 8
#: Hex characters of a digest.
WIDE = 64
#: Levels that one block holds; it has ``FAN ** LEVELS`` nodes.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def digest(*fields: Column) -> Column:
    """The leaf over ``fields``, in order."""
    told = []
    for c in fields:
        s = c.cast("string")
        told.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*told), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _parents(level: Column) -> Column:
    """The next level of a block: one digest per run of 8."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * WIDE)).cast("int"))
    hashed = F.transform(runs, lambda r: F.sha2(F.substr(level, r * (FAN * WIDE) + 1, F.lit(FAN * WIDE)), 256))
    return F.concat_ws("", hashed)


def blocks(nodes: DataFrame, group: list[str], kept: list[str], name: str) -> DataFrame:
    """Rows (group, pos, n, digest, kept) as one row per aligned block: its level strings ``l0``.. and its last digest, ``top``.

    ``n`` is the number of nodes in the group; a group in one block stops at the level that has one node.
    """
    member = F.struct("pos", "digest", *kept)
    out = (
        nodes.groupBy(*group, "n", F.floor(F.col("pos") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .withColumn("l0", F.concat_ws("", F.col("members.digest")))
    )
    for j in range(LEVELS):
        above = F.when(F.col("n") > FAN**j, _parents(F.col(f"l{j}"))).otherwise(F.col(f"l{j}"))
        out = out.withColumn(f"l{j + 1}", above)
    keep = [F.col(f"members.{c}").alias(c) for c in kept]
    return stage(out.select(*group, "n", "block", *keep, *[f"l{j}" for j in range(LEVELS)], F.col(f"l{LEVELS}").alias("top")), name)


def _steps(i: Column) -> Column:
    """The flanks of node ``i`` of a block on each level that the block's group has."""
    steps = []
    for j in range(LEVELS):
        place = F.floor(i / FAN**j).cast("int")
        run = F.substr(F.col(f"l{j}"), F.floor(place / FAN).cast("int") * (FAN * WIDE) + 1, F.lit(FAN * WIDE))
        off = (place % FAN) * WIDE
        flanks = F.struct(F.substr(run, F.lit(1), off).alias("left"), F.substr(run, off + WIDE + 1, F.lit(FAN * WIDE)).alias("right"))
        steps.append(F.when(F.col("n") > FAN**j, F.array(flanks)).otherwise(F.array().cast(_STEPS)))
    return F.concat(*steps)


def _nodes_of(level: DataFrame, group: list[str]) -> DataFrame:
    """The blocks of a round as the nodes of the next."""
    return level.select(*group, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))


def _children(level: DataFrame, group: list[str]) -> DataFrame:
    """(group, pos, steps) of every node of a round whose blocks have ``steps``, their own way up."""
    many = (F.length("l0") / WIDE).cast("int")
    ways = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.concat(_steps(i), F.col("steps")))
    return level.select(*group, "block", F.posexplode(ways).alias("i", "steps")).select(
        *group, (F.col("block") * BLOCK + F.col("i")).alias("pos"), "steps"
    )


class Tree:
    """The rounds of blocks over nodes (group, pos, n, digest); a group's subroot is the top of its only last block."""

    def __init__(self, nodes: DataFrame, group: list[str], kept: list[str], largest: int, name: str) -> None:
        self.group = group
        self.rounds = [blocks(nodes, group, kept, name)]
        while largest > BLOCK:
            largest = -(-largest // BLOCK)
            self.rounds.append(blocks(_nodes_of(self.rounds[-1], group), group, [], name))

    def roots(self) -> DataFrame:
        return self.rounds[-1].select(*self.group, F.col("top").alias("subroot"))

    def leaves(self, above: DataFrame) -> DataFrame:
        """The first round's blocks with ``steps`` from the block up; ``above`` has the steps of each group's subroot."""
        g = self.group
        named = above.select(*[F.col(c).alias(f"{c}_") for c in g], *[c for c in above.columns if c not in g])
        top = self.rounds[-1]
        top = top.join(named, same(top, named, g)).drop(*[f"{c}_" for c in g])
        more = [c for c in above.columns if c not in (*g, "steps")]
        for level in self.rounds[-2::-1]:
            down = _children(top, g).select(*[F.col(c).alias(f"{c}_") for c in g], F.col("pos").alias("block_"), "steps")
            level = level.join(down, same(level, down, [*g, "block"])).drop(*[f"{c}_" for c in g], "block_")
            if more:
                told = named.drop("steps")
                level = level.join(told, same(level, told, g)).drop(*[f"{c}_" for c in g])
            top = level
        return top


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """Leaf, subroot, root, proof and the root folded from a possibly altered leaf, per row of ``docs``.

    ``altered`` says which rows to check with the text in lower case (A-Z only) instead of their own; none by default.
    """
    rows = pick(docs, *dict.fromkeys((*fields, key, group, text)))
    changed = digest(*[lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields])
    tampered = F.coalesce(altered, F.lit(False)) if altered is not None else F.lit(False)
    leaves = rows.select(
        F.col(key).alias("id"), F.col(group).alias("g"), digest(*[F.col(c) for c in fields]).alias("digest"),
        F.when(tampered, changed).alias("altered"),
    )
    leaves = stage(leaves, "merkle-digests")
    placed = places(in_order(leaves, [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")], "merkle-leaves"), ["g"])
    tree = Tree(placed, ["g"], ["id", "altered"], _largest(leaves), "merkle")
    groups = in_order(tree.roots(), [F.col("g").asc_nulls_first()], "merkle-groups")
    kinds = groups.count()
    over = Tree(places(groups, []).withColumnRenamed("subroot", "digest").withColumn("all", F.lit(0)), ["all"], ["g"], kinds, "merkle-root")
    root = over.roots().select(F.col("all"), F.col("subroot").alias("root"), F.array().cast(_STEPS).alias("steps"))
    tops = over.leaves(root)
    many = (F.length("l0") / WIDE).cast("int")
    each = F.transform(
        F.sequence(F.lit(0), many - 1),
        lambda i: F.struct(F.col("g")[i].alias("g"), F.substr(F.col("l0"), i * WIDE + 1, F.lit(WIDE)).alias("subroot"), F.concat(_steps(i), F.col("steps")).alias("steps")),
    )
    above = tops.select("root", F.explode(each).alias("x")).select("x.g", "x.subroot", "root", "x.steps")
    base = tree.leaves(stage(above, "merkle-above"))
    return _folded(base, key)


def _largest(leaves: DataFrame) -> int:
    """Rows of the largest group: one number."""
    return leaves.groupBy("g").count().agg(F.max("count")).first()[0] or 0


def _folded(base: DataFrame, key: str) -> DataFrame:
    many = F.size("id")

    def one(i: Column) -> Column:
        return F.struct(
            F.col("id")[i].alias("id"), F.substr(F.col("l0"), i * WIDE + 1, F.lit(WIDE)).alias("leaf"), F.col("changes")[i].alias("altered"),
            F.concat(_steps(i), F.col("steps")).alias("steps"),
        )

    rows = base.withColumnRenamed("altered", "changes").select(
        "subroot", "root", F.explode(F.transform(F.sequence(F.lit(0), many - 1), one)).alias("x")
    )
    flanks = F.transform(F.col("x.steps"), lambda s: F.concat(s["left"], s["right"]))
    start = F.coalesce(F.col("x.altered"), F.col("x.leaf"))
    folded = F.aggregate(F.col("x.steps"), start, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))
    return rows.select(
        F.col("x.id").alias(key), F.col("x.leaf").alias("leaf"), "subroot", "root",
        F.sha2(F.concat_ws("", flanks), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; rows whose id's crc32 is divisible by 3 are checked with a lower-cased text."""
    return manifest(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 0)


def _leaf_sql(text: str) -> str:
    told = [f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(told)})"


OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0
         THEN {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), levels AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM levels
  WHERE n > 1 GROUP BY lang, level, pos // 8
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops
  WHERE n > 1 GROUP BY level, pos // 8
), runs AS (
  SELECT 0 AS tree, lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM levels WHERE n > 1 GROUP BY lang, level, pos // 8
  UNION ALL
  SELECT 1, NULL, level, pos // 8, list(digest ORDER BY pos) FROM tops WHERE n > 1 GROUP BY level, pos // 8
), steps AS (
  SELECT p.lang, p.pos, 0 AS tree, r.level, (p.pos // (8 ** r.level)::BIGINT) % 8 AS place, r.digests
  FROM placed p JOIN runs r ON r.tree = 0 AND r.lang IS NOT DISTINCT FROM p.lang AND r.run = p.pos // (8 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.lang, p.pos, 1, r.level, (s.pos // (8 ** r.level)::BIGINT) % 8, r.digests
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN runs r ON r.tree = 1 AND r.run = s.pos // (8 ** (r.level + 1))::BIGINT
), ways AS (
  SELECT lang, pos, list({{'l': array_to_string(digests[1:place], ''), 'r': array_to_string(digests[place + 2:], '')}} ORDER BY tree, level) AS way
  FROM steps GROUP BY lang, pos
), folded AS (
  SELECT p.*, coalesce(way, []) AS way FROM placed p LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos
), done AS (
  SELECT *, list_reduce(list_transform(way, lambda s: s.l || ':' || s.r), lambda now, s: sha256(string_split(s, ':')[1] || now || string_split(s, ':')[2]), coalesce(altered, leaf)) AS folded_root
  FROM folded
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
  sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root,
  folded_root = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM done JOIN subroots s ON s.lang IS NOT DISTINCT FROM done.lang
"""
