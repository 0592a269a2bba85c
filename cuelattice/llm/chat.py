"""Conversations from reply trees.

Messages point at the message they reply to. Self-joins that double the length of the known path in each round (a message's path to an
ancestor, joined to that ancestor's own path) enumerate all root-to-leaf paths in a logarithmic number of rounds. The
branches of a tree are ranked by score, and the best ones are each formatted as one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

KEEP = 3
TURN_STEP = 3


def messages_of(conversations: DataFrame, step: int = TURN_STEP) -> DataFrame:
    """conversations (conv_id, turn, role, text) as reply trees (tree_id, node_id, parent_id, role, text, score).

    The table has no reply pointers, so they follow from the turn: each turn replies to the one before, but every step-th one (an odd
    step keeps the two sides apart) replies to the turn `step` earlier, as a second answer there. The score of a message is its length.
    """
    parent = F.expr(f"case when turn <= 0 then null when turn % {step} = 0 then turn - {step} else turn - 1 end")
    return conversations.select(F.col("conv_id").alias("tree_id"), F.col("turn").alias("node_id"), parent.alias("parent_id"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("score"))


def _nodes(messages: DataFrame) -> DataFrame:
    rows = messages.where("tree_id is not null and node_id is not null")
    rest = F.struct(F.col("parent_id"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).alias("score"))
    return rows.groupBy("tree_id", "node_id").agg(F.min(rest).alias("m")).select("tree_id", "node_id", "m.*")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, path): the node_ids from the root to each message that has a root, without texts or scores.

    Messages whose ancestors lead to a missing message or in a circle have no path.
    """
    state = written(nodes.select("tree_id", "node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("path")), "reply-paths")
    while state.where("up is not null").limit(1).count():
        above = state.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        longer = state.where("up is not null").join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("further").alias("up"), F.concat("before", "path").alias("path"))
        # a path that meets itself, or whose next ancestor it holds already, goes in a circle
        longer = longer.where("(up is null or not array_contains(path, up)) and size(path) = size(array_distinct(path))")
        state = written(state.where("up is null").unionByName(longer), "reply-paths")
    return state.select("tree_id", "node_id", "path")


def best_branches(messages: DataFrame, keep: int = KEEP) -> DataFrame:
    """(tree_id, branch, leaf_id, path, turns, score, conversation) of the `keep` best root-to-leaf paths of each tree.

    branch counts from 1 by the mean score of the path's messages, downwards; of equal ones that of the least leaf_id comes first. path has
    the node_ids, joined by commas. conversation is, for each message, <|role|>, a newline, its text and <|end|> with a newline;
    "<|" in a text becomes "< |", so that a text can't close its own turn.

    Messages of null tree_id or node_id count as absent; of several with one id the least (parent, role, text, score) stays. A
    null parent makes a root, and a tree may have many. A null role is "unknown", a null text empty, a null score 0. Messages
    below a missing message, or in a circle, are on no path. Extra columns don't pass. An empty table gives no rows.
    """
    nodes = written(_nodes(messages), "reply-nodes")
    leaves = paths(nodes.select("tree_id", "node_id", "parent_id")).join(nodes.select("tree_id", F.col("parent_id").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    steps = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), F.posexplode("path").alias("at", "node_id"))
    points = steps.join(nodes.select("tree_id", "node_id", "score"), ["tree_id", "node_id"])
    scored = points.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("at", "node_id", "score"))).alias("l"))
    scored = scored.withColumn("score", F.expr("aggregate(l, 0D, (s, x) -> s + x.score) / size(l)"))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "leaf_id"))
    chosen = scored.withColumn("branch", rank).where(F.col("branch") <= keep)
    chosen = written(chosen.select("tree_id", "branch", "leaf_id", "score", F.transform("l", lambda x: x["node_id"]).alias("ids")), "reply-branches")
    turns = chosen.select("tree_id", "branch", "leaf_id", "score", F.posexplode("ids").alias("at", "node_id")).join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    full = turns.groupBy("tree_id", "branch", "leaf_id", "score").agg(F.sort_array(F.collect_list(F.struct("at", "node_id", said.alias("said")))).alias("l"))
    return full.select(
        "tree_id", "branch", "leaf_id",
        F.array_join(F.transform("l", lambda x: x["node_id"].cast("string")), ",").alias("path"), F.size("l").alias("turns"), "score",
        F.array_join(F.transform("l", lambda x: x["said"]), "").alias("conversation"),
    )


def best_branches_sql(keep: int = KEEP, step: int = TURN_STEP) -> str:
    """DuckDB SQL for `best_branches(messages_of(conversations))`, going down from the roots."""
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id AS tree_id, turn AS node_id, CASE WHEN turn <= 0 THEN NULL WHEN turn % {step} = 0 THEN turn - {step} ELSE turn - 1 END AS parent_id,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(length(text), 0) AS score
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
nodes AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY parent_id, role, text, score) AS n FROM raw) q WHERE n = 1),
down AS (
  SELECT tree_id, node_id, CAST(node_id AS VARCHAR) AS path, 1 AS turns, CAST(score AS DOUBLE) AS total,
    '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS conversation
  FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.tree_id, n.node_id, d.path || ',' || CAST(n.node_id AS VARCHAR), d.turns + 1, d.total + n.score,
    d.conversation || '<|' || n.role || '|>' || chr(10) || replace(n.text, '<|', '< |') || '<|end|>' || chr(10)
  FROM down d JOIN nodes n ON n.tree_id = d.tree_id AND n.parent_id = d.node_id
),
leaves AS (SELECT d.*, d.total / d.turns AS score FROM down d LEFT JOIN (SELECT DISTINCT tree_id, parent_id FROM nodes) p ON p.tree_id = d.tree_id AND p.parent_id = d.node_id WHERE p.tree_id IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, node_id) AS branch FROM leaves)
SELECT tree_id, CAST(branch AS INTEGER) AS branch, node_id AS leaf_id, path, CAST(turns AS INTEGER) AS turns, score, conversation FROM ranked WHERE branch <= {keep}"""
