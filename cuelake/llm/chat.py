"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

A conversation's turns get token counts; their prefix sums place the turn-aligned window borders. Every window
repeats the system turn and a limited history, both masked, and then shows its own turns; text under the loss
mask is assistant text that no earlier window has shown as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, pick, table

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 96
#: Strings that chat templates in use treat as control; inside texts each gets a backslash after its first character.
CONTROL = r"<(?=s>|/s>|<SYS>>|</SYS>>|\||start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)|\[(?=/?INST\]|/?TOOL|/?AVAILABLE)"
_END = "<|end|>\n"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks every control string by one single backslash; unescape undoes both."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    """Tokens of a turn, estimated as a quarter of its bytes, rounded up, and four for the marks around it."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def _prefix(values: Column) -> Column:
    """Inclusive prefix sums; one pass, in blocks so that no long array is copied for every element."""
    block = 64

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
        parts = F.transform(starts, lambda s: F.slice(v, s, F.lit(block)))
        return let(parts, summed)

    def fold(p: Column) -> Column:
        zero = F.array().cast("array<bigint>")
        return F.aggregate(p, zero, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + x)))

    def summed(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        offsets = let(fold(sums), lambda t: F.transform(t, lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(t, i - 1))))
        return let(offsets, lambda o: F.flatten(F.transform(parts, lambda p, b: F.transform(fold(p), lambda x: x + F.get(o, b)))))

    return let(values, blocks)


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, window_no, n_repeated, n_own, formatted, loss array<struct<start,length>>, n_tokens.

    formatted is the template's text; loss gives the code points of it that are trained on. The first n_repeated
    turns of a window were shown before. Own turns stay within budget less the system turn and the history,
    except where one turn alone is larger; it then is a window by itself and is kept whole.

    With prefix sums of tokens, a turn that crosses a multiple of the capacity (half of what the system turn and the
    history leave of the budget) opens a window; if it alone is larger than the capacity, so does the turn after it.
    A window so holds at most twice the capacity, or one larger turn. Turns stay rows until their window is known:
    each goes to its own window and to those that repeat it, so the cost is that of the output, however long a
    conversation is.

    Null texts and roles are empty ones. Turns are ordered by turn, null first; ties by role and text. Repeated
    rows are turns of their own. Rows of null conv_id are one conversation. An empty table gives no window.
    Other columns are left out.
    """
    c = pick(conversations, "conv_id", "turn", "role", "text")
    c = c.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("n", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    t = c.withColumn("at", F.row_number().over(order))
    t = t.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system_n", F.first(F.when(F.col("system"), F.col("n")).otherwise(F.lit(0).cast("long"))).over(so_far))
    t = t.withColumn("sum", F.coalesce(F.sum(F.when(F.col("system"), 0).otherwise(F.col("n"))).over(before), F.lit(0).cast("long")))
    t = t.withColumn("prev_n", F.lag(F.when(F.col("system"), None).otherwise(F.col("n"))).over(order))
    # own turns get half of what is left as capacity: a window may reach twice that
    t = t.withColumn("capacity", F.greatest(F.floor((F.lit(budget) - F.col("system_n") - history_tokens) / 2), F.lit(32)).cast("long"))
    crosses = F.expr("sum div capacity <> (sum + n - 1) div capacity")
    opens = F.when(F.col("system"), 0).when(F.col("prev_n").isNull() | crosses | (F.col("prev_n") > F.col("capacity")), 1).otherwise(0)
    t = t.withColumn("opens", opens)
    t = t.withColumn("window_no", F.greatest(F.sum("opens").over(so_far) - 1, F.lit(0)))
    ahead = [F.lead(F.when(F.col("opens") == 1, F.col("window_no")), k).over(order).alias(f"ahead_{k}") for k in range(1, history_turns + 1)]
    last = F.max("window_no").over(Window.partitionBy("conv_id")).alias("last_no")
    t = t.select("conv_id", "at", "role", "text", "n", "system", "window_no", *ahead, last)
    # a turn goes to its own window (kind 2), as history to windows that open soon after it (1), and a system turn to all others (0)
    place = lambda no, kind: F.struct(no.cast("long").alias("window_no"), F.lit(kind).alias("kind"))
    past = F.filter(F.array(place(F.lit(None), 1), *[place(F.when(~F.col("system"), F.col(f"ahead_{k}")), 1) for k in range(1, history_turns + 1)]), lambda p: p["window_no"].isNotNull())
    none = F.array().cast("array<struct<window_no:bigint,kind:int>>")
    others = F.when(F.col("system") & (F.col("last_no") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.col("last_no")), lambda no: place(no, 0))).otherwise(none)
    t = t.select("conv_id", "at", "role", "n", F.col("system"), escape(F.col("text")).alias("escaped"), F.explode(F.concat(F.array(place(F.col("window_no"), 2)), past, others)).alias("p"))
    marked = F.concat(F.lit("<|"), F.url_encode("role"), F.lit("|>\n"), F.col("escaped"), F.lit(_END))
    turn = F.struct(F.col("p.kind").alias("kind"), "at", "role", "n", "system", F.length("escaped").alias("chars"), marked.alias("marked"))
    w = t.groupBy("conv_id", F.col("p.window_no").alias("window_no")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    total = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    of = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    w = w.select("conv_id", "window_no", of(0).alias("again"), of(1).alias("back"), of(2).alias("own"))
    room = F.least(F.lit(history_tokens).cast("long"), F.lit(budget) - total("again") - total("own"))
    w = w.withColumn("room", room)
    # the longest tail of the history that fits: a turn stays if it and all after it do
    history = F.filter("back", lambda x, i: total(F.slice("back", i + 1, F.size("back"))) <= F.col("room"))
    w = w.withColumn("repeated", F.concat("again", history))
    w = w.withColumn("shown", F.concat("repeated", "own")).withColumn("ends", _prefix(F.transform("shown", lambda x: F.length(x["marked"]).cast("long"))))
    targets = F.filter(F.transform("shown", lambda x, i: F.when((i >= F.size("repeated")) & (x["role"] == "assistant"), F.struct((F.get("ends", i) - F.length(F.lit(_END)) - x["chars"]).alias("start"), x["chars"].cast("long").alias("length")))), lambda s: s.isNotNull())
    return w.select(
        "conv_id", "window_no", F.size("repeated").alias("n_repeated"), F.size("own").alias("n_own"),
        F.array_join(F.transform("shown", lambda x: x["marked"]), "").alias("formatted"), targets.alias("loss"), total("shown").alias("n_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a window's text as array<struct<role,text>>, unescaped: the inverse of the template."""
    # no text holds an unescaped mark, so the end marks part the turns; what follows the last is empty
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    one = lambda p: let(F.locate("|>\n", p), lambda at: F.struct(F.url_decode(F.substring(p, F.lit(3), at - 3)).alias("role"), unescape(F.substring(p, at + 3, F.length(p))).alias("text")))
    return F.transform(parts, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(wins: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and masks alone: conv_id, turns, loss_text, formatted_chars."""
    own = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.col("n_own"), F.lit(0)))
    per = wins.select("conv_id", F.struct("window_no", own.alias("own"), read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    convs = per.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return convs.select(
        "conv_id", F.flatten(F.transform("ws", lambda w: w["own"])).alias("turns"), F.array_join(F.transform("ws", lambda w: w["loss_text"]), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.sql("select -1L conv_id, 0 turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -1L, 1, 'assistant', '</s>[INST] ok [/INST]'")
    back = read_back(windows(c.unionByName(extra)))
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars",
    )


#: The template's lengths are stated beside its texts: a turn's mark, its escaped text, the end mark. No control string holds
#: a part of another one, and none holds a backslash, so both can be counted in the text as it is.
ORACLE_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (
  select *, cast(ceil(strlen(text) / 4.0) as bigint) + 4 as n, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
    length('<||>' || role) + 1 + length(text) + {len(_END)} + len(regexp_extract_all(text, '\\'))
      + len(regexp_extract_all(text, '<(?:s>|/s>|<SYS>>|</SYS>>|\||start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)|\[(?:/?INST\]|/?TOOL|/?AVAILABLE)')) as chars
  from c),
s as (select *, first_value(case when role = 'system' then n else 0 end) over o as system_n, pos = 1 and role = 'system' as is_system from t window o as (partition by conv_id order by pos)),
k as (
  select *, greatest((512 - system_n - 96) // 2, 32) as capacity, coalesce(sum(case when is_system then 0 else n end) over (o rows between unbounded preceding and 1 preceding), 0) as before,
    lag(case when is_system then null else n end, 1) over o as n1, lag(case when is_system then null else n end, 2) over o as n2, lag(chars, 1) over o as chars1, lag(chars, 2) over o as chars2
  from s window o as (partition by conv_id order by pos)),
p as (select *, case when is_system then 0 when n1 is null or before // capacity <> (before + n - 1) // capacity or n1 > capacity then 1 else 0 end as opens from k),
q as (select *, greatest(sum(opens) over (partition by conv_id order by pos) - 1, 0) as window_no from p),
w as (select *, least(96, 512 - system_n - sum(case when is_system then 0 else n end) over (partition by conv_id, window_no)) as room, first_value(case when role = 'system' then chars else 0 end) over (partition by conv_id order by pos) as system_chars from q)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case when opens = 1 and window_no > 0 then system_chars + case when n1 <= room then chars1 + case when n1 + n2 <= room then chars2 else 0 end else 0 end else 0 end) as bigint) as formatted_chars
from w group by conv_id
"""
