"""Quotation linking of conversations, in DataFrame operations alone.

A message is cut into lines. The marks ``>`` before a line give its quote level; a
line of level 0 is the message's own. Lines of one level are joined to one text, so
a quote that a mail client wrapped anew still fits. Every ``WORDS`` words in a row
are hashed, and shorter lines and sentences as a whole. A quoted piece joins to the
latest earlier message of its conversation that has it among its own words; the
message that most quoted words of level 1 come from is the one replied to, or of
the next level where nothing of a level is known. Replies make trees; a
conversation in reply order goes through its trees, oldest first, and each of them
by turn.

Quoted pieces and their owners meet in one stream ordered by turn, so no quoting is
paired with another. A conversation of any size is never gathered: its messages
stay rows, and trees are found by :func:`~tidewatch.llm.common.components`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import components, materialize, source, table

_MARKS = r"^((?:[ \t]*>)+)"
#: "On <when>, <who> wrote:" before a quote.
_INTRO = r"^(?:On|Am|Le|El) .+(?:wrote|schrieb|écrit|escribió)[^:]*:$"


#: Words of a piece; shorter lines and sentences are pieces as they are.
WORDS = 5


def level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[ \t]", ""))


def content(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS + " ?", "")


def passage(lines: Column, at: Column) -> Column:
    """The text of one level in lower case; a blank line where lines of another level stood."""
    return F.lower(F.array_join(F.transform(lines, lambda x: F.when(x["level"] == at, content(x["line"])).otherwise("")), "\n"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def with_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with the lines of ``text`` and their levels; a line that introduces a quote counts as quoted.

    The levels are a column of a step of their own, so a line looks at the next one and
    nothing is worked out twice.
    """
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    marked = rows.withColumn("marked", F.transform(lines, lambda x: F.struct(x.alias("line"), level(x).alias("level"))))

    def judge(x: Column, i: Column) -> Column:
        follows = F.coalesce(F.get(F.col("marked"), i + 1)["level"], F.lit(0)) > 0
        intro = follows & x["line"].rlike(_INTRO)
        return F.struct(x["line"].alias("line"), F.when(intro, -1).otherwise(x["level"]).alias("level"))

    return marked.withColumn("lines", F.transform("marked", judge)).drop("marked")


def own_text(lines: Column) -> Column:
    """The lines of level 0, without blank lines before, after, and where a quote went."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.regexp_replace(F.regexp_replace(own, r"\A\s*\n|\s+\z", ""), r"\n(?:[ \t]*\n){2,}", "\n\n")


def pieces(messages: DataFrame) -> DataFrame:
    """uid, conv_id, turn, level, hash, start and size (in words of the level's text) of every piece of ``text``."""
    keys = ["uid", "conv_id", "turn", "level"]
    in_order = Window.partitionBy("uid", "level").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)

    def short(cut: Column) -> DataFrame:
        each = messages.select(*keys, F.posexplode(cut).alias("nth", "piece")).withColumn("words", words_of(F.col("piece")))
        each = each.withColumn("size", F.size("words")).withColumn("start", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        each = each.filter((F.col("size") > 0) & (F.col("size") < WORDS))
        return each.select(*keys, F.md5(F.array_join("words", " ")).alias("hash"), F.col("start").cast("int").alias("start"), "size")

    lines = short(F.split("text", "\n"))
    sentences = short(F.split("text", r"(?<=[.!?])\s+|\n\s*\n"))
    words = messages.select(*keys, words_of(F.col("text")).alias("words")).filter(F.size("words") >= WORDS)
    windows = F.transform("words", lambda w, i: F.md5(F.concat_ws(" ", w, *[F.get(F.col("words"), i + k) for k in range(1, WORDS)])))
    windows = F.slice(windows, F.lit(1), F.size("words") - WORDS + 1)
    runs = words.select(*keys, F.posexplode(windows).alias("start", "hash")).select(*keys, "hash", "start", F.lit(WORDS).alias("size"))
    return lines.union(sentences).union(runs).withColumn("hash", F.unhex("hash"))


def reply_votes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, from and words: how many quoted words of a level come from which message."""
    rows = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("uid", F.monotonically_increasing_id())
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    quoting = rows.select("uid", "conv_id", "turn", "lines", F.explode(F.filter(levels, lambda x: x > 0)).alias("level"))
    text = passage(F.col("lines"), F.col("level")).alias("text")
    quoted = materialize(pieces(quoting.select("uid", "conv_id", "turn", "level", text)), "chat-quoted")
    # Only conversations with quotes are cut into own pieces, and only pieces that are quoted are kept.
    own = rows.withColumn("level", F.lit(0)).join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    own = pieces(own.select("uid", "conv_id", "turn", "level", text)).select("conv_id", "hash", "turn").distinct()
    own = own.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    asked = quoted.select("conv_id", "hash", "turn").distinct().withColumn("own", F.lit(0))
    # A message never answers itself: its question comes before its own piece.
    before = Window.partitionBy("conv_id", "hash").orderBy("turn", "own")
    owners = own.withColumn("own", F.lit(1)).unionByName(asked)
    owners = owners.withColumn("from", F.last(F.when(F.col("own") == 1, F.col("turn")), ignorenulls=True).over(before))
    owners = owners.filter("own = 0 AND `from` IS NOT NULL").select("conv_id", "hash", "turn", "from")
    found = quoted.join(owners, ["conv_id", "hash", "turn"])
    found = found.withColumn("word", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)))
    found = found.select("conv_id", "turn", "level", "from", "uid", "word").distinct()
    return found.groupBy("conv_id", "turn", "level", "from").agg(F.count(F.lit(1)).alias("words"))


def link_quotes(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message with what it replies to and its own words.

    conv_id, turn, role, reply_to (turn of the message replied to), thread (turn of
    the tree's first message), n_quoted (lines), depth (deepest level) and text
    without quotes. Sorted by (conv_id, thread, turn) a conversation reads in reply
    order. Only earlier messages of the same conversation are replied to; the latest
    that has the quoted words, and where two give as many words, the later one. Messages that quote nothing known begin
    a tree. Null ids or turns link with nothing, null texts have no lines, and rows
    with the same id and turn are one message with the lines of all.
    """
    rows = source(messages, conv_id=conv_id, turn=turn, role=role, text=text)
    rows = materialize(with_lines(rows), "chat-lines")
    best = F.max(F.struct((-F.col("level")).alias("near"), "words", "from"))
    replies = reply_votes(rows).groupBy("conv_id", "turn").agg(best["from"].alias("reply_to"))
    replies = materialize(replies, "chat-replies")
    edges = replies.select(F.struct("conv_id", "turn").alias("a"), F.struct("conv_id", F.col("reply_to").alias("turn")).alias("b"))
    trees = components(edges).select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.turn").alias("thread"))
    facts = trees.join(replies, ["conv_id", "turn"], "left")
    out = rows.join(facts, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.size(F.filter("lines", lambda x: x["level"] != 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("depth"),
        own_text(F.col("lines")).alias("text"),
    )


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as reply trees, without quotes."""
    return link_quotes(table(spark, sf_dir, "conversations"))


_INTRO_SQL = _INTRO.replace("'", "''")
OP5_SQL = rf"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER () AS uid, conv_id, turn, role,
                               string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM conversations),
cut AS (SELECT uid, conv_id, turn, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM msgs),
marked AS (SELECT *, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[ \t]', '', 'g')) AS marks FROM cut),
levelled AS (SELECT uid, conv_id, turn, pos, line, CASE WHEN coalesce(lead(marks) OVER (PARTITION BY uid ORDER BY pos), 0) > 0
               AND regexp_matches(line, '{_INTRO_SQL}') THEN -1 ELSE marks END AS level FROM marked),
each AS (SELECT conv_id, turn, level, lower(trim(regexp_replace(regexp_replace(line, '^((?:[ \t]*>)+) ?', ''), '\s+', ' ', 'g'))) AS norm FROM levelled
         WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
originals AS (SELECT conv_id, norm, min(turn) AS source FROM each WHERE level = 0 AND norm <> '' GROUP BY ALL),
quoted AS (SELECT DISTINCT conv_id, turn, norm, len(string_split(norm, ' ')) AS words FROM each WHERE level = 1 AND norm <> ''),
votes AS (SELECT q.conv_id, q.turn, source, sum(words) AS words FROM quoted q JOIN originals o ON q.conv_id = o.conv_id AND q.norm = o.norm
          WHERE source < q.turn GROUP BY ALL),
replies AS (SELECT conv_id, turn, max(row(words, source)) AS best FROM votes GROUP BY ALL),
parents AS (SELECT conv_id, turn, best[2] AS reply_to FROM replies),
up(conv_id, turn, above) AS (SELECT conv_id, turn, reply_to FROM parents
  UNION ALL SELECT up.conv_id, up.turn, p.reply_to FROM up JOIN parents p ON up.conv_id = p.conv_id AND up.above = p.turn),
roots AS (SELECT conv_id, turn, min(above) AS thread FROM up GROUP BY ALL),
facts AS (SELECT uid, count(*) FILTER (level <> 0) AS n_quoted, greatest(max(level), 0) AS depth,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '') AS own FROM levelled GROUP BY uid)
SELECT m.conv_id, m.turn, m.role, reply_to, coalesce(thread, m.turn) AS thread, n_quoted, depth,
       regexp_replace(regexp_replace(own, '\A\s*\n|\s+\z', '', 'g'), '\n(?:[ \t]*\n){{2,}}', chr(10) || chr(10), 'g') AS text
FROM msgs m JOIN facts USING (uid) LEFT JOIN parents p ON m.conv_id = p.conv_id AND m.turn = p.turn
     LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn"""
