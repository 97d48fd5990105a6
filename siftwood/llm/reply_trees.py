"""Reply trees: root-to-leaf paths by iterative self-joins, ranked branches, one conversation for each chosen path.

Messages point at their parents. Pointer doubling finds every message's root, depth and path score in a number of
self-joins that grows with the logarithm of the depth, and with a constant amount of state a message (no path
is carried along). Leaves are ranked per tree by score, then the chosen leaves walk back up through the saved jumps, largest first,
which marks the messages of their paths. Only then are texts joined and each path formatted.

Template: `<turn ROLE>TEXT</turn>` and a line feed for each message. In roles and texts the characters
that could form a control string are written as codes: \\ as \\b, < as \\l, > as \\g, # as \\h. Unescaping is exact, and no text can open or close a turn.

Defined cases: null texts and roles are empty; a null score is 0. A parent that is null, missing, or the message itself makes a root. Messages on a
cycle of parents, and messages that hang off one, belong to no tree and yield no path. Repeated (tree, message) ids keep one row, the smallest by role and text,
the smallest parent and the largest score. Ties of scores go to the smallest leaf id. Null tree ids are one tree. Texts of any length are formatted whole; one conversation must fit
in a row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.llm.common import Scratch

END = "</turn>\n"
#: Fixed codes of the template, in the order of unescaping; the backslash is first when escaping.
CODES = (("<", "\\l"), (">", "\\g"), ("#", "\\h"), ("\\", "\\b"))


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'") + "'"


def escaped(x: str) -> str:
    for raw, code in reversed(CODES):
        x = f"replace({x}, {_lit(raw)}, {_lit(code)})"
    return x


def unescaped(x: str) -> str:
    for raw, code in CODES:
        x = f"replace({x}, {_lit(code)}, {_lit(raw)})"
    return x


def chosen_paths(messages: DataFrame, scratch: Scratch, paths: int = 1, max_rounds: int = 40) -> DataFrame:
    """(tree, path, depth, node): the messages of the `paths` best root-to-leaf paths of each tree, roots at depth 0.

    messages: tree, node, parent, score. A path's score is the mean of its messages' scores.
    """
    m = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    m = scratch.write(m, "nodes")
    known = m.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    up = m.join(known, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")) & (F.col("parent") != F.col("node")), "left")
    # `sum` and `len` cover the messages from a node up to, not including, its jump; a root jumps to null. A message that has met its root
    # leaves the rounds, so round k costs the messages deeper than 2^k
    first = scratch.write(up.select("tree", "node", F.col("n2").alias("to"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("len")), "jump-0")
    done, active = first.where("to IS NULL"), first.where("to IS NOT NULL")
    jumps, left = [], active.count()
    for k in range(1, max_rounds + 1):
        if not left:
            break
        jumps.append(active)
        far = active.unionByName(done).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("to").alias("to2"), F.col("sum").alias("s2"), F.col("len").alias("l2"))
        step = active.join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("to") == F.col("n2")))
        step = scratch.write(step.select("tree", "node", F.col("to2").alias("to"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("len") + F.col("l2")).alias("len")), f"jump-{k}")
        done, active = done.unionByName(step.where("to IS NULL")), step.where("to IS NOT NULL")
        before, left = left, active.count()
        if left == before:
            break  # only cycles still jump: every other chain loses messages in each round
    parents = m.where("parent IS NOT NULL AND parent <> node").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("sum") / F.col("len")).desc(), "node"))
    best = leaves.withColumn("path", rank).where(F.col("path") <= paths).select("tree", "path", "node")
    marked = scratch.write(best, "marked")
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "to")
        more = marked.join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "path", F.col("to").alias("node"))
        marked = scratch.write(marked.unionByName(more).distinct(), f"marked-{k}")
    depth = done.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), (F.col("len") - 1).alias("depth"))
    return marked.join(depth, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "path", "depth", "node")


def format_paths(messages: DataFrame, paths: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """messages: tree, node, parent, role, text, score. Returns tree, path, n_turns, formatted and loss: the
    (start, length) spans, in code points, of the assistant texts in `formatted`.
    """
    scratch = scratch or Scratch(messages.sparkSession, "reply-trees")
    chosen = chosen_paths(messages.select("tree", "node", "parent", "score"), scratch, paths)
    texts = messages.groupBy(F.col("tree").alias("t2"), F.col("node").alias("n2")).agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    rows = chosen.join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    turn = F.expr(f"concat('<turn ', {escaped('m.role')}, '>')").alias("head"), F.expr(escaped("m.text")).alias("body")
    parts = rows.select("tree", "path", "depth", *turn, (F.col("m.role") == "assistant").alias("learn")).groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    out = parts.select("tree", "path", F.size("turns").cast("long").alias("n_turns"), F.expr(f"array_join(transform(turns, t -> concat(t.head, t.body, {_lit(END)})), '')").alias("formatted"), "turns")
    spans = f"""aggregate(turns, struct(CAST(1 AS BIGINT) AS at, CAST(array() AS ARRAY<STRUCT<start: BIGINT, len: BIGINT>>) AS spans),
      (a, t) -> struct(a.at + length(t.head) + length(t.body) + {len(END)} AS at,
        IF(t.learn, concat(a.spans, array(struct(a.at + length(t.head) AS start, CAST(length(t.body) AS BIGINT) AS len))), a.spans) AS spans), a -> a.spans)"""
    return scratch.keep(out.withColumn("loss", F.expr(spans)).drop("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted conversation itself says: turns (role, text), read from `formatted` alone, and loss_text, all text under the loss mask, unescaped."""
    pieces = f"filter(split(formatted, {_lit(END)}, -1), (p, i) -> p LIKE '<turn %')"
    turn = f"transform({pieces}, p -> struct({unescaped('substr(p, 7, locate(' + chr(39) + '>' + chr(39) + ', p) - 7)')} AS role, {unescaped('substr(p, locate(' + chr(39) + '>' + chr(39) + ', p) + 1)')} AS text))"
    loss = f"array_join(transform(loss, s -> {unescaped('substr(formatted, CAST(s.start AS INT), CAST(s.len AS INT))')}), '')"
    return formatted.withColumn("turns", F.expr(turn)).withColumn("loss_text", F.expr(loss))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: rows by turn (then role and text) reply to the row before. Null turns come last."""
    c = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return c.withColumn("node", F.row_number().over(order).cast("long")).withColumn("parent", F.expr("IF(node = 1, NULL, node - 1)")).withColumn("score", F.lit(1.0)).drop("turn")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation with digests of what is read back from its formatted form."""
    scratch = Scratch(conversations.sparkSession, "reply-trees")
    messages = scratch.write(conversation_messages(conversations), "messages")
    back = read_back(format_paths(messages, 1, scratch))
    return scratch.keep(
        back.select(
            F.col("tree").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
            F.expr("CAST(length(loss_text) AS BIGINT)").alias("loss_chars"),
            F.expr("sha2(loss_text, 256)").alias("loss_sha256"),
            F.expr("CAST(length(formatted) AS BIGINT)").alias("formatted_chars"),
        )
    )


#: The conversation that every run formats besides the table's.
TRAP = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
