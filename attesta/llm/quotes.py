"""Quotation linking: replies are joined to what they quote, and conversations rebuilt without quotes.

Lines that begin with '>' are quotes; the number of marks is the level. Each run of lines of one
level is a passage. Passages are normalised (case, marks, blanks), hashed, and joined to the passages
that messages wrote themselves. A message replies to the one whose words it quotes at the lowest
level; the tree of replies gives the order of each conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import checkpointed, forget, quoted

#: Shortest normalised text, in characters, that a single line is linked by; whole passages are linked at any length.
LEAST_LINE = 20
_PREFIX = r"^((?:[ \t]*>)+)"
_LEAD_IN = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds to ``t`` its own text ``body`` and its ``passages``: array of (level, lines), in order."""
    marks = F.transform(
        F.split(F.regexp_replace(F.coalesce("t", F.lit("")), "\r\n?", "\n"), "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _PREFIX, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, _PREFIX + "[ \t]?", "").alias("line"),
        ),
    )
    d = messages.withColumn("lines", marks)
    at = F.col("lines")
    n = F.size(at)
    lead = lambda x, i: (x["level"] == 0) & x["line"].rlike(_LEAD_IN) & (i + 1 < n) & (F.get(at, i + 1)["level"] > 0)
    told = F.transform(at, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.coalesce(lead(x, i), F.lit(False)).alias("lead")))
    d = d.withColumn("lines", told).withColumn("lines", F.filter("lines", lambda x: ~x["lead"]))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), lambda i: (i == 0) | (F.get(F.col("lines"), i)["level"] != F.get(F.col("lines"), i - 1)["level"]))
    d = d.withColumn("starts", F.when(F.size("lines") == 0, F.array().cast("array<int>")).otherwise(starts))
    passages = F.transform(
        F.col("starts"),
        lambda s, j: F.struct(
            F.get(F.col("lines"), s)["level"].alias("level"),
            F.slice(F.col("lines"), s + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size("lines")) - s)["line"].alias("lines"),
        ),
    )
    own = F.filter("lines", lambda x: x["level"] == 0)["line"]
    body = F.trim(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))
    return d.withColumn("passages", passages).withColumn("body", body).drop("lines", "starts")


def unit_hashes(passages: Column) -> Column:
    """Array of (h, size, level): each passage whole, each of its blank-separated paragraphs and its longer lines."""

    def of(p: Column) -> Column:
        whole = F.array_join(p["lines"], "\n")
        parts = F.array_union(F.transform(F.split(whole, r"\n[ \t]*\n"), normalised), F.array(normalised(whole)))
        lines = F.filter(F.transform(p["lines"], normalised), lambda x: F.length(x) >= LEAST_LINE)
        return F.transform(F.filter(F.array_union(parts, lines), lambda x: x != ""), lambda x: F.struct(F.md5(x).alias("h"), F.length(x).alias("size"), p["level"].alias("level")))

    return F.flatten(F.transform(passages, of))


def threads(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: thread, position, conv_id, turn, role, body, parent_conv_id, parent_turn, depth, link, n_quotes.

    A message's parent is the message that wrote what it quotes: at the lowest level, in its own
    conversation rather than another, the longest quotation, the latest before it. In another
    conversation only earlier ones count (a lower conv_id), of these the first to have written it; so
    replies never go round in a circle. A message that quotes nothing known replies to the turn before
    it (link 'turn'); the first of a conversation is a root (link 'root') unless it quotes an earlier
    conversation, which ties the two into one thread. In a thread messages stand by depth, then
    conversation and turn, so each comes after its parent.

    A null text is an empty message. A message whose conversation is null or no whole number is one of its own, together
    with its repetitions; turns that are null or no whole numbers come first. Messages with equal turns stand by role, then text;
    repeated rows are so many messages. Other columns are not read. An empty table gives an empty one.
    """
    raw = messages.select(
        quoted(conversation).try_cast("long").alias("conv"), quoted(turn).try_cast("long").alias("turn"), quoted(role).cast("string").alias("role"), quoted(text).cast("string").alias("t")
    )
    name = F.coalesce(F.col("conv").cast("string"), F.concat(F.lit("m:"), F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("-")) for x in ("turn", "role", "t")]))))
    rank = F.coalesce(F.col("conv"), F.lit(2**63 - 1).cast("long"))
    order = Window.partitionBy("c").orderBy("turn", "role", "t")
    placed = raw.withColumn("c", name).withColumn("n", rank).withColumn("pos", F.row_number().over(order))
    d = parsed(placed)
    d = checkpointed(d.select("n", "c", "pos", "conv", "turn", "role", "body", F.filter("passages", lambda p: p["level"] == 0).alias("own"), F.filter("passages", lambda p: p["level"] > 0).alias("quoted")))

    said = d.select("n", "c", "pos", F.explode(unit_hashes(F.col("own"))).alias("u")).select("n", "c", "pos", "u.h").distinct()
    cites = d.select("n", "c", "pos", F.explode(unit_hashes(F.col("quoted"))).alias("u")).select("n", "c", "pos", "u.h", "u.size", "u.level").groupBy("n", "c", "pos", "h", "size").agg(F.min("level").alias("level"))

    both = said.select("n", "c", "pos", "h", F.col("pos").alias("said"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("level")).unionByName(
        cites.select("n", "c", "pos", "h", F.lit(None).cast("int").alias("said"), "size", "level")
    )
    earlier = Window.partitionBy("c", "h").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("to", F.last("said", ignorenulls=True).over(earlier)).where("level is not null")
    near = within.where("to is not null").select("n", "c", "pos", "level", "size", F.col("n").alias("pn"), F.col("c").alias("pc"), F.col("to").alias("pp"), F.lit(1).alias("own"))
    first = said.groupBy("h").agg(F.min(F.struct("n", "c", "pos")).alias("at"))
    far = (
        cites.join(first, "h")
        .where(F.struct(F.col("at.n"), F.col("at.c")) < F.struct("n", "c"))
        .select("n", "c", "pos", "level", "size", F.col("at.n").alias("pn"), F.col("at.c").alias("pc"), F.col("at.pos").alias("pp"), F.lit(0).alias("own"))
    )
    best = F.max(F.struct((-F.col("level")).alias("l"), "own", "size", F.when(F.col("own") == 1, F.col("pp")).otherwise(-F.col("pp")).alias("late"), "pn", "pc", "pp"))
    link = near.unionByName(far).groupBy("c", "pos").agg(best.alias("b")).select("c", "pos", "b.pc", "b.pp")

    tied = d.join(link, ["c", "pos"], "left").select(
        "n", "c", "pos", "conv", "turn", "role", "body", F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("pc", F.when(F.col("pos") > 1, F.col("c"))).alias("pc"), F.coalesce("pp", F.when(F.col("pos") > 1, F.col("pos") - 1)).alias("pp"),
        F.when(F.col("pc").isNotNull(), "quote").when(F.col("pos") > 1, "turn").otherwise("root").alias("link"),
    )
    tied = checkpointed(tied)

    # pointer jumping: the ancestor found so far and how far it is; each round doubles the distance
    jumps = tied.select("c", "pos", F.coalesce("pc", "c").alias("ac"), F.coalesce("pp", "pos").alias("ap"), F.when(F.col("pc").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    last = None
    while True:
        jumps = checkpointed(jumps)
        if last is not None:
            forget(last)
        last = jumps
        above = jumps.select(F.col("c").alias("ac"), F.col("pos").alias("ap"), F.col("ac").alias("bc"), F.col("ap").alias("bp"), F.col("depth").alias("more"))
        ahead = jumps.join(above, ["ac", "ap"])
        if not ahead.where("more > 0").limit(1).count():
            break
        jumps = ahead.select("c", "pos", F.col("bc").alias("ac"), F.col("bp").alias("ap"), (F.col("depth") + F.col("more")).alias("depth"))

    parents = tied.select(F.col("c").alias("pc"), F.col("pos").alias("pp"), F.col("conv").alias("parent_conv_id"), F.col("turn").alias("parent_turn"))
    out = tied.join(jumps, ["c", "pos"]).join(parents, ["pc", "pp"], "left")
    line = Window.partitionBy("ac", "ap").orderBy("depth", "n", "c", "pos")
    return out.select(
        F.col("ac").alias("thread"), F.row_number().over(line).cast("long").alias("position"), F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role),
        "body", "parent_conv_id", "parent_turn", "depth", "link", "n_quotes",
    )


def with_quotations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages as mail would have them: each quotes the turn before it under a lead-in line, and in it the one
    before that; every third turn quotes only the one before the last. A null text is quoted as an empty line."""
    at = Window.partitionBy(quoted(conversation)).orderBy(quoted(turn), quoted(role), quoted(text))
    marked = lambda mark, n: F.concat(F.lit(mark), F.replace(F.lag(F.coalesce(quoted(text), F.lit("")), n).over(at), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    wrote = F.concat(F.lit("On an earlier day "), F.coalesce(F.lag(quoted(role)).over(at), F.lit("somebody")), F.lit(" wrote:\n"))
    deep, near = marked(">> ", 2), marked("> ", 1)
    third = (F.row_number().over(at) % 3 == 0) & deep.isNotNull()
    said = F.coalesce(quoted(text), F.lit(""))
    whole = F.when(third, F.concat(marked("> ", 2), said)).when(near.isNotNull(), F.concat(wrote, F.coalesce(deep, F.lit("")), near, said)).otherwise(said)
    return messages.select(quoted(conversation).alias("conv_id"), quoted(turn).alias("turn"), quoted(role).alias("role"), whole.alias("text"))


def with_quotations_sql(table: str = "conversations") -> str:
    """The same in DuckDB's SQL."""
    marked = lambda mark, n: f"'{mark}' || replace(lag(coalesce(text, ''), {n}) OVER placed, chr(10), chr(10) || '{mark}') || chr(10)"
    return f"""(SELECT conv_id, turn, role, CASE
  WHEN row_number() OVER placed % 3 = 0 AND lag(coalesce(text, ''), 2) OVER placed IS NOT NULL THEN {marked("> ", 2)} || coalesce(text, '')
  WHEN lag(coalesce(text, ''), 1) OVER placed IS NOT NULL THEN 'On an earlier day ' || coalesce(lag(role) OVER placed, 'somebody') || ' wrote:' || chr(10) || coalesce({marked(">> ", 2)}, '') || {marked("> ", 1)} || coalesce(text, '')
  ELSE coalesce(text, '') END AS text
FROM {table} WINDOW placed AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))"""


def sql(table: str = "conversations") -> str:
    """The same in DuckDB's SQL."""
    norm = lambda x: rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE raw AS (SELECT CAST(conv_id AS BIGINT) AS conv, CAST(turn AS BIGINT) AS turn, role, text AS t FROM {table}),
named AS (SELECT *, coalesce(CAST(conv AS VARCHAR), 'm:' || md5(concat_ws('|', coalesce('=' || turn, '-'), coalesce('=' || role, '-'), coalesce('=' || t, '-')))) AS c, coalesce(conv, 9223372036854775807) AS n FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role NULLS FIRST, t NULLS FIRST) AS pos FROM named),
cut AS (SELECT n, c, pos, string_split(regexp_replace(coalesce(t, ''), '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM placed),
each AS (SELECT n, c, pos, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM cut),
levels AS (
  SELECT n, c, pos, i, len(regexp_replace(regexp_extract(x, '{_PREFIX}', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '{_PREFIX}[ \t]?', '') AS line FROM each),
ahead AS (SELECT *, lead(level) OVER (PARTITION BY c, pos ORDER BY i) AS after FROM levels),
lines AS (SELECT n, c, pos, i, level, line FROM ahead WHERE NOT coalesce(level = 0 AND after > 0 AND regexp_matches(line, '{_LEAD_IN}'), false)),
marked AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY c, pos ORDER BY i) THEN 0 ELSE 1 END AS head FROM lines),
grouped AS (SELECT *, sum(head) OVER (PARTITION BY c, pos ORDER BY i) AS g FROM marked),
passages AS (SELECT n, c, pos, g, any_value(level) AS level, string_agg(line, chr(10) ORDER BY i) AS whole, list({norm("line")} ORDER BY i) AS own FROM grouped GROUP BY n, c, pos, g),
units AS (
  SELECT n, c, pos, level, unnest(list_distinct(list_concat(list_concat(list_transform(string_split_regex(whole, '\n[ \t]*\n'), lambda p: {norm("p")}), [{norm("whole")}]),
    list_filter(own, lambda p: len(p) >= {LEAST_LINE})))) AS h FROM passages),
said AS (SELECT DISTINCT n, c, pos, h FROM units WHERE level = 0 AND h <> ''),
cites AS (SELECT n, c, pos, h, len(h) AS size, min(level) AS level FROM units WHERE level > 0 AND h <> '' GROUP BY n, c, pos, h),
near AS (SELECT q.n, q.c, q.pos, q.level, q.size, 1 AS own, q.c AS pc, max(s.pos) AS pp FROM cites q JOIN said s ON q.c = s.c AND q.h = s.h AND s.pos < q.pos GROUP BY q.n, q.c, q.pos, q.h, q.level, q.size),
firsts AS (SELECT h, n AS fn, c AS fc, pos AS fp FROM said QUALIFY row_number() OVER (PARTITION BY h ORDER BY n, c, pos) = 1),
far AS (SELECT n, c, pos, level, size, 0 AS own, fc AS pc, fp AS pp FROM cites JOIN firsts USING (h) WHERE fn < n OR (fn = n AND fc < c)),
links AS (
  SELECT c, pos, pc, pp FROM (SELECT * FROM near UNION ALL SELECT * FROM far)
  QUALIFY row_number() OVER (PARTITION BY c, pos ORDER BY level, own DESC, size DESC, CASE WHEN own = 1 THEN -pp ELSE pp END, pc DESC, pp DESC) = 1),
bodies AS (SELECT c, pos, regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '^\s+|\s+$', '', 'g') AS body FROM lines GROUP BY c, pos),
quoted AS (SELECT c, pos, count(*) FILTER (level > 0) AS n_quotes FROM passages GROUP BY c, pos),
tied AS (
  SELECT p.n, p.c, p.pos, p.conv, p.turn, p.role, coalesce(b.body, '') AS body, coalesce(q.n_quotes, 0) AS n_quotes,
    coalesce(l.pc, CASE WHEN p.pos > 1 THEN p.c END) AS pc, coalesce(l.pp, CASE WHEN p.pos > 1 THEN p.pos - 1 END) AS pp,
    CASE WHEN l.pc IS NOT NULL THEN 'quote' WHEN p.pos > 1 THEN 'turn' ELSE 'root' END AS link
  FROM placed p LEFT JOIN links l USING (c, pos) LEFT JOIN bodies b USING (c, pos) LEFT JOIN quoted q USING (c, pos)),
tree AS (
  SELECT c, pos, c AS root, pos AS root_pos, CAST(0 AS BIGINT) AS depth FROM tied WHERE pc IS NULL
  UNION ALL SELECT t.c, t.pos, r.root, r.root_pos, r.depth + 1 FROM tied t JOIN tree r ON t.pc = r.c AND t.pp = r.pos)
SELECT r.root AS thread, CAST(row_number() OVER (PARTITION BY r.root, r.root_pos ORDER BY r.depth, t.n, t.c, t.pos) AS BIGINT) AS position, t.conv AS conv_id, t.turn, t.role, t.body,
  u.conv AS parent_conv_id, u.turn AS parent_turn, r.depth, t.link, CAST(t.n_quotes AS BIGINT) AS n_quotes
FROM tied t JOIN tree r USING (c, pos) LEFT JOIN tied u ON t.pc = u.c AND t.pp = u.pos"""
