"""The queries of the library's own operators, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import languages, text, timecode
from ..operators import audio, call_log, cues, grid, match, overlay, paid_once, refine, segment, timeline, tools
from ..operators import resample as resample_
from ..operators.providers import EnergyVad
from .. import schema
from ..session import shared_path
from ..sources import documents, srt, wav_files
from . import views
from .views import CALLS, CUES, MEDIA, MERGED, STATE, table, timecode_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- cues -------------------------------------------------------------------------------------------------------


@_register(f"with {CUES} select track, cue_id, start_ms, end_ms, text from cues")
def cue_view(spark, d):
    return views.cues(spark, d).drop("user_id")


@_register(f"with recursive {MERGED} select track, start_ms, end_ms, text, cue_id, n_merged from merged")
def merge_short(spark, d):
    return cues.merge_short(views.cues(spark, d))


@_register(f"with {CUES} select track, cue_id, row_number() over (partition by track order by start_ms, cue_id) as number from cues")
def number_cues(spark, d):
    return cues.number_cues(views.cues(spark, d)).select("track", "cue_id", "number")


def _listed(spark, d):
    """Cues in list order of cue_id rather than time, some without text, some before zero."""
    c = views.cues(spark, d)
    return c.select("track", F.col("cue_id").alias("ord"), (F.col("start_ms") - 2000).alias("start_ms"), (F.col("end_ms") - 2000).alias("end_ms"), F.expr("case when cue_id % 97 <> 0 then text end").alias("text"))


@_register(f"""
with {CUES},
listed as (select track, cue_id, start_ms - 2000 as start_ms, end_ms - 2000 as end_ms, case when cue_id % 97 <> 0 then text end as text from cues),
placed as (select *, row_number() over w - 1 as position, lead(start_ms) over w as next_ms from listed window w as (partition by track order by cue_id))
select track, position, 'missing_text' as issue from placed where text is null
union all select track, position, 'negative_start' from placed where start_ms < 0
union all select track, position, 'negative_end' from placed where end_ms < 0
union all select track, position, 'end_not_after_start' from placed where end_ms <= start_ms
union all select track, position, 'overlap' from placed where next_ms < end_ms
""")
def timing_issues(spark, d):
    return cues.timing_issues(_listed(spark, d), per_block=1000)


@_register("""
with d as (select source as track, doc_id as ord, len(string_split(coalesce(text, ''), chr(10))) = 2 as two, row_number() over (partition by source order by doc_id) as r from documents)
select track, count(*) as n, count(*) filter (two) as n_two_lines, count(*) filter (two) >= 0.8 * count(*) as is_bilingual from d where r <= 5 group by track
""")
def bilingual_share(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("track"), F.col("doc_id").alias("ord"), "text")
    return cues.bilingual_share(docs)


# --- timecodes and text -----------------------------------------------------------------------------------------


@_register(f"with {CUES} select cue_id, {timecode_sql('start_ms')} as start_code, {timecode_sql('end_ms - 5000')} as end_code from cues")
def timecode_format(spark, d):
    return views.cues(spark, d).select("cue_id", timecode.format_timecode(F.col("start_ms")).alias("start_code"), timecode.format_timecode(F.col("end_ms") - 5000).alias("end_code"))


@_register("""
with k as (select event_id, case event_id % 4 when 0 then user_id % 100 || ':05:07,' || event_id % 1000 || ' tail' when 1 then '01:02:03.500' when 2 then user_id % 9 || 'h:2x:03,5' else '01:02' end as code from events)
select event_id, case event_id % 4 when 0 then (cast(split_part(code, ':', 1) as bigint) * 3600 + 307) * 1000 + event_id % 1000 end as strict_ms,
  case event_id % 4 when 0 then (cast(split_part(code, ':', 1) as bigint) * 3600 + 307) * 1000 + event_id % 1000 when 2 then cast(left(code, 1) as bigint) * 3600000 + 123005 end as lenient_ms
from k
""")
def timecode_parse(spark, d):
    code = F.expr("case event_id % 4 when 0 then user_id % 100 || ':05:07,' || event_id % 1000 || ' tail' when 1 then '01:02:03.500' when 2 then user_id % 9 || 'h:2x:03,5' else '01:02' end")
    e = table(spark, d, "events").select("event_id", code.alias("code"))
    return e.select("event_id", timecode.parse_timecode(F.col("code")).alias("strict_ms"), timecode.parse_timecode(F.col("code"), "lenient").alias("lenient_ms"))


@_register("""
with recursive lines as (
  select doc_id, pos, regexp_replace(trim(line), ' +', ' ', 'g') as line
  from (select doc_id, unnest(string_split(trim(text, concat(' ', chr(9), chr(10), chr(13))), chr(10))) as line, generate_subscripts(string_split(trim(text, concat(' ', chr(9), chr(10), chr(13))), chr(10)), 1) as pos from documents)),
words as (select doc_id, pos, string_split(line, ' ') as w from lines where length(line) > 80),
fill as (
  select doc_id, pos, w, 1 as i, w[1] as now, 1 as row_no from words
  union all
  select doc_id, pos, w, i + 1, case when length(now) + 1 + length(w[i + 1]) <= 80 then now || ' ' || w[i + 1] else w[i + 1] end,
    case when length(now) + 1 + length(w[i + 1]) <= 80 then row_no else row_no + 1 end
  from fill where i < len(w)),
rows_ as (
  select doc_id, pos, row_no, arg_max(now, i) as line from fill group by doc_id, pos, row_no
  union all select doc_id, pos, 1, line from lines where length(line) <= 80)
select doc_id, md5(string_agg(line, chr(10) order by pos, row_no)) as wrapped_md5, count(*) as n_lines from rows_ group by doc_id
""")
def wrap_text(spark, d):
    w = table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("w"))
    return w.select("doc_id", F.md5("w").alias("wrapped_md5"), F.size(F.split("w", "\n", -1)).cast("bigint").alias("n_lines"))


@_register("""
with l as (select doc_id, string_split(trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(13))), chr(10)) as l from documents)
select doc_id, trim(l[1]) as target, trim(coalesce(l[2], l[1])) as source from l
""")
def bilingual_extract(spark, d):
    p = text.bilingual_pair(F.col("text"))
    return table(spark, d, "documents").select("doc_id", p["target"].alias("target"), p["source"].alias("source"))


@_register("""
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents)
select doc_id, case when len(l) = 2 then l[1] else text end as first, case when len(l) = 2 then l[2] else '' end as second from l
""")
def bilingual_exact(spark, d):
    p = text.exact_pair(F.col("text"))
    return table(spark, d, "documents").select("doc_id", p["first"].alias("first"), p["second"].alias("second"))


def _turns(spark, d):
    c = table(spark, d, "conversations").where("conv_id is not null")
    q = c.where("role = 'user'").select("conv_id", "turn", F.expr("case when turn % 3 = 2 then '' else text end").alias("source"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return q.join(a, ["conv_id", "turn"], "full")


_TURNS = """
q as (select conv_id, turn, case when turn % 3 = 2 then '' else text end as source from conversations where role = 'user'),
a as (select conv_id, turn - 1 as turn, text as target from conversations where role = 'assistant'),
t as (select coalesce(q.conv_id, a.conv_id) as conv_id, coalesce(q.turn, a.turn) as turn, nullif(source, '') as s, nullif(target, '') as t from q full join a on q.conv_id = a.conv_id and q.turn = a.turn)
"""


@_register(f"""
with {_TURNS}
select conv_id, turn, case when t is not null and s is not null then t || chr(10) || s when t is not null then t || chr(10) || '{text.NO_SOURCE}' else '{text.NO_TARGET}' || chr(10) || s end as text
from t where t is not null or s is not null
""")
def bilingual_compose(spark, d):
    out = _turns(spark, d).select("conv_id", "turn", text.compose(F.col("target"), F.col("source")).alias("text"))
    return out.where("text is not null")


@_register(f"with {_TURNS} select conv_id, turn, t as text from t where t is not null")
def mono_compose(spark, d):
    return _turns(spark, d).select("conv_id", "turn", text.compose(F.col("target"), F.col("source"), bilingual=False).alias("text")).where("text is not null")


# --- names and options --------------------------------------------------------------------------------------------

_NAME = "'clip' || page_id || case page_id % 5 when 0 then '.eng-cmn.srt' when 1 then '.JPN-xyz.srt' when 2 then '.fr-de.srt' when 3 then '.spa-rus.refined.srt' else '.srt' end"


@_register(f"""
with f as (select page_id, {_NAME} as name from pages),
p as (select *, lower(regexp_extract(name, '\\.([a-zA-Z]{{3}})-([a-zA-Z]{{3}})(?:\\.refined)?\\.srt$', 1)) as a, lower(regexp_extract(name, '\\.([a-zA-Z]{{3}})-([a-zA-Z]{{3}})(?:\\.refined)?\\.srt$', 2)) as b,
  regexp_extract(left(name, length(name) - 4), '\\.([a-z]{{2,3}})-([a-z]{{2,3}})(?:\\.refined)?$', 1) as sa from f)
select page_id, nullif(a, '') as first, nullif(b, '') as second, nullif(sa, '') as stem_source,
  case nullif(a, '') when 'eng' then 'English' when 'spa' then 'Spanish' when 'jpn' then 'Japanese' else upper(nullif(a, '')) end as first_name
from p
""")
def lang_from_name(spark, d):
    name = F.expr(_NAME)
    p = table(spark, d, "pages").select("page_id", languages.languages_of_file(name).alias("l"), languages.languages_of_stem(F.regexp_replace(name, r"\.srt$", "")).alias("s"))
    rows = p.select("page_id", F.col("l.first").alias("first"), F.col("l.second").alias("second"), F.col("s.source").alias("stem_source"))
    return languages.with_language_name(rows, "first", "first_name")


_OPTION = "case event_id % 5 when 0 then 'eng:cmn' when 1 then ' fra : deu ' when 2 then 'eng' when 3 then 'a:b:c' else ':x' end"


@_register("select event_id, case event_id % 5 when 0 then 'eng' when 1 then 'fra' end as source, case event_id % 5 when 0 then 'cmn' when 1 then 'deu' end as target from events")
def language_pair(spark, d):
    p = languages.language_pair(F.expr(_OPTION))
    return table(spark, d, "events").select("event_id", p["source"].alias("source"), p["target"].alias("target"))


@_register("select page_id, 'clip' || page_id || '.eng-cmn.srt' as bilingual, 'clip' || page_id || '.cmn.srt' as mono, 'clip' || page_id || '.cmn.wav' as dub, 'clip' || page_id || '.cmn.cloned.wav' as clone, 'clip' || page_id || '.eng-cmn.refined.srt' as refined from pages")
def output_names(spark, d):
    stem = F.concat(F.lit("clip"), F.col("page_id").cast("string"))
    a, b = F.lit("eng"), F.lit("cmn")
    both = languages.output_name(stem, a, b, bilingual=True)
    return table(spark, d, "pages").select("page_id", both.alias("bilingual"), languages.output_name(stem, a, b).alias("mono"), languages.output_name(stem, a, b, "dub").alias("dub"), languages.output_name(stem, a, b, "clone").alias("clone"), languages.refined_name(both).alias("refined"))


@_register("select event_id, cast(coalesce(json_extract_string(props, '$.k'), '-1') as bigint) as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing from events")
def json_prop(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("-1")).cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


# --- SRT ------------------------------------------------------------------------------------------------------------


@_register(f"""
with recursive {MERGED},
n as (select *, row_number() over (partition by track order by start_ms, cue_id) as number from merged),
words as (select track, number, string_split(text, ' ') as w from n where length(text) > 80),
fill as (
  select track, number, w, 1 as i, w[1] as now, 1 as row_no from words
  union all
  select track, number, w, i + 1, case when length(now) + 1 + length(w[i + 1]) <= 80 then now || ' ' || w[i + 1] else w[i + 1] end,
    case when length(now) + 1 + length(w[i + 1]) <= 80 then row_no else row_no + 1 end
  from fill where i < len(w)),
rows_ as (select track, number, row_no, arg_max(now, i) as line from fill group by track, number, row_no),
wrapped as (select track, number, string_agg(line, chr(10) order by row_no) as lines from rows_ group by track, number)
select n.track, n.number, n.number || chr(10) || {timecode_sql('start_ms')} || ' --> ' || {timecode_sql('end_ms')} || chr(10) || coalesce(lines, text) || chr(10) as entry
from n left join wrapped on wrapped.track = n.track and wrapped.number = n.number
""")
def srt_entries(spark, d):
    return srt.srt_entries(views.cues(spark, d))


def _files(spark, d):
    """One file per user: its cues."""
    return views.cues(spark, d).withColumn("track", F.col("user_id").cast("string")).drop("user_id")


@_register(f"""
with {CUES},
n as (select *, row_number() over (partition by user_id order by start_ms, cue_id) as number from cues),
e as (select user_id, number, number || chr(10) || {timecode_sql('start_ms')} || ' --> ' || {timecode_sql('end_ms')} || chr(10) || text || chr(10) as entry from n)
select cast(user_id as varchar) as track, string_agg(entry, chr(10) order by number) as content from e group by user_id
""")
def srt_render(spark, d):
    return srt.render_srt(_files(spark, d), merge=False)


@_register(f"with {CUES} select cast(user_id as varchar) as track, row_number() over (partition by user_id order by start_ms, cue_id) as cue_index, start_ms, end_ms, text from cues")
def srt_parse_roundtrip(spark, d):
    return srt.parse_srt(srt.render_srt(_files(spark, d), merge=False)).select("track", "cue_index", "start_ms", "end_ms", "text")


@_register(f"""
with {CUES},
t as (select *, start_ms - 5000000 as s, end_ms - 5000000 as e from cues),
x as (select *, case when s < 0 then '-' else '' end || {timecode_sql('abs(s)')} || ' --> ' || case when e < 0 then '-' else '' end || {timecode_sql('abs(e)')} as times from t)
select cast(user_id as varchar) as track, string_agg(cue_id || chr(10) || times || chr(10) || text || chr(10), chr(10) order by cue_id) as content from x group by user_id
""")
def srt_as_parsed(spark, d):
    """Indices, order and texts as they are; times before zero keep their sign."""
    c = views.cues(spark, d)
    return srt.render_as_parsed(c.select(F.col("user_id").cast("string").alias("track"), F.col("cue_id").alias("ord"), F.col("cue_id").alias("cue_index"), (F.col("start_ms") - 5000000).alias("start_ms"), (F.col("end_ms") - 5000000).alias("end_ms"), "text"))


_MESSY = "'1' || n || '0:00:01,000 --> 0:00:02,500' || n || 'one' || n || n || '2x' || n || 'at 0:00:03,5 --> 0:00:04,000 X1:0' || n || 'two' || n || 'zwei' || n || '  ' || n || 'bad' || n || n || 'y' || n || '0:0:1,0 --> 0:0:2,0' || n || 'z'"


@_register("""
select cast(page_id as varchar) as track, i as cue_index, s as start_ms, e as end_ms, t as text
from pages, (values (1, 1000, 2500, 'one'), (2, 3005, 4000, 'two' || chr(10) || 'zwei')) v(i, s, e, t)
""")
def srt_parse_lenient(spark, d):
    n = F.expr("case page_id % 3 when 0 then '\\n' when 1 then '\\r\\n' else '\\r' end").alias("n")
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("track"), n).select("track", F.expr(_MESSY).alias("content"))
    return srt.parse_srt(files, "lenient").select("track", "cue_index", "start_ms", "end_ms", "text")


_REST = "'one' || n || n || '2x' || n || 'at 0:00:03,5 --> 0:00:04,000 X1:0' || n || 'two' || n || 'zwei' || n || '  ' || n || 'bad' || n || n || 'y' || n || '0:0:1,0 --> 0:0:2,0' || n || 'z'"


@_register(f"""
with f as (select page_id, case page_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10) else chr(13) end as n from pages)
select cast(page_id as varchar) as track, 1 as cue_index, 1000 as start_ms, 2500 as end_ms, case page_id % 3 when 0 then 'one' else {_REST} end as text from f where page_id % 3 <> 2
""")
def srt_parse_strict(spark, d):
    """Of files with \\r\\n, no blank line parts the entries: all that follows is the first one's text. A file with \\r is one line, and no entry."""
    n = F.expr("case page_id % 3 when 0 then '\\n' when 1 then '\\r\\n' else '\\r' end").alias("n")
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("track"), n).select("track", F.expr(_MESSY).alias("content"))
    return srt.parse_srt(files).select("track", "cue_index", "start_ms", "end_ms", "text")


@_register("""
with c as (select doc_id, '<div class="card"><h3>' || replace(replace(source, '&', '&amp;'), '<', '&lt;') || '</h3><audio controls src="' || 'f' || doc_id || '.wav"></audio></div>' as card, lang from documents where doc_id % 3 <> 0)
select lang as page, md5(string_agg(card, chr(10) order by doc_id)) as cards_md5, count(*) as n from c group by lang
""")
def html_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("page"), F.col("doc_id").alias("position"), F.col("source").alias("label"), F.format_string("f%d.wav", "doc_id").alias("file"))
    listing = docs.where("position % 3 <> 0").select("file")
    pages = documents.html_index(docs, listing)
    body = F.regexp_extract("html", r"(?s) files</p>\n(.*)\n</body>", 1)
    return pages.select("page", F.md5(body).alias("cards_md5"), F.size(F.split(body, "\n")).cast("bigint").alias("n"))


# --- matching -------------------------------------------------------------------------------------------------------


def _sides(spark, d):
    c = views.cues(spark, d)
    frags = c.where("track = 'view'").select(F.col("cue_id").alias("frag_id"), "start_ms", "end_ms")
    return c.where("track = 'click'"), frags


_MATCH = f"""
{CUES},
best as (
  select c.cue_id, f.cue_id as frag_id, f.start_ms as frag_start_ms, f.end_ms as frag_end_ms, abs(c.start_ms - f.start_ms) + abs(c.end_ms - f.end_ms) as diff_ms
  from cues c join cues f on f.track = 'view' and f.start_ms between c.start_ms - 500 and c.start_ms + 500
  where c.track = 'click'
  qualify row_number() over (partition by c.cue_id order by abs(c.start_ms - f.start_ms) + abs(c.end_ms - f.end_ms), f.cue_id) = 1)
"""


@_register(f"with {_MATCH} select cue_id, frag_id, frag_start_ms, frag_end_ms, diff_ms from best")
def fragment_match(spark, d):
    return match.match_fragments(*_sides(spark, d))


@_register(f"with {_MATCH} select cue_id, start_ms, text from cues where track = 'click' and cue_id not in (select cue_id from best)")
def fragment_unmatched(spark, d):
    c, f = _sides(spark, d)
    return match.unmatched(c, match.match_fragments(c, f)).select("cue_id", "start_ms", "text")


@_register(f"with {_MATCH} select count(*) as n_cues, count(b.cue_id) as n_matched, count(*) - count(b.cue_id) as n_unmatched from cues c left join best b using (cue_id) where track = 'click'")
def match_counts(spark, d):
    c, f = _sides(spark, d)
    m = match.match_fragments(c, f).select("cue_id", F.lit(1).alias("hit"))
    return c.join(m, "cue_id", "left").agg(F.count("*").alias("n_cues"), F.count("hit").alias("n_matched"), (F.count("*") - F.count("hit")).alias("n_unmatched"))


@_register(f"with {CUES} select cue_id as frag_id, 'f' || cue_id || '.wav' as file from cues where track = 'view' and cue_id % 3 = 0")
def fragments_with_file(spark, d):
    f = _sides(spark, d)[1].withColumn("file", F.format_string("f%d.wav", "frag_id"))
    return match.existing(f, f.where("frag_id % 3 = 0").select("file")).select("frag_id", "file")


@_register(f"""
with {CUES} select cue_id, case cue_id % 4 when 1 then track else 't' || cue_id end as target_text, case cue_id % 4 when 1 then track else track end as source_text from cues where cue_id % 4 in (0, 1)
""")
def usable_cues(spark, d):
    """Two lines, one line, no text, and a second line of white space behind a mark."""
    c = views.cues(spark, d).withColumn("text", F.expr("case cue_id % 4 when 0 then concat('t', cue_id, '\\n', track) when 1 then track when 2 then '' else concat('t', cue_id, '\\n \\n', track) end"))
    return match.usable_cues(c).select("cue_id", "target_text", "source_text")


@_register(f"""
with {CUES}, f as (select user_id, cue_id, start_ms, end_ms, 'f' || cue_id || '.wav' as file from cues)
select cast(user_id as varchar) as media_id, cue_id as frag_id, file, start_ms, end_ms, count(*) over (partition by user_id) as fragment_count from f
where user_id not in (select user_id from f where cue_id % 97 = 3)
""")
def timeline_cache(spark, d):
    """Media of which no file is missing, written as a timeline's JSON and read from it."""
    f = views.cues(spark, d).select(F.col("user_id").cast("string").alias("media_id"), F.col("cue_id").alias("frag_id"), F.format_string("f%d.wav", "cue_id").alias("file"), "start_ms", "end_ms")
    whole = documents.complete_timeline(f, f.where("frag_id % 97 <> 3").select("file"))
    media = whole.groupBy("media_id").agg(F.max("end_ms").alias("total_ms")).select("media_id", F.lit("in.wav").alias("input_file"), "total_ms", F.lit(16000).alias("sample_rate"), F.lit("out").alias("output_dir"))
    t = documents.timeline_json(whole, media).select("media_id", F.from_json("json", schema.TIMELINE).alias("t"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return t.select("media_id", F.col("t.metadata.fragment_count").cast("bigint").alias("fragment_count"), F.explode("t.timeline").alias("f")).select("media_id", F.col("f.id").alias("frag_id"), "f.file", ms("f.start").alias("start_ms"), ms("f.end").alias("end_ms"), "fragment_count")


# --- timelines ------------------------------------------------------------------------------------------------------


@_register(f"with {MEDIA} select media_id, row_number() over (partition by media_id order by start_ms) - 1 as frag_id, start_ms, end_ms from media")
def chunk_stitch(spark, d):
    """Cut at chunk borders and stitched again, the spans are what they were."""
    return timeline.stitch(timeline.cut_at_chunks(views.media(spark, d))).select("media_id", "frag_id", "start_ms", "end_ms")


@_register(f"""
with {MEDIA}, c as (select media_id, start_ms as s, end_ms as e, unnest(range(start_ms // 30000, (end_ms - 1) // 30000 + 1)) as chunk_no from media),
x as (select media_id, chunk_no, greatest(s, chunk_no * 30000) as start_ms, least(e, (chunk_no + 1) * 30000) as end_ms from c)
select *, abs(end_ms - (chunk_no + 1) * 30000) < 100 as is_incomplete from x
""")
def chunk_segments(spark, d):
    return timeline.incomplete(timeline.cut_at_chunks(views.media(spark, d)))


@_register(f"""
with {MEDIA}, t as (select media_id, max(end_ms) as total_ms from media group by media_id),
c as (select media_id, total_ms, unnest(range(0, cast(ceil(total_ms / 30000.0) as bigint))) as chunk_no from t)
select media_id, chunk_no, chunk_no * 30000 as start_ms, least((chunk_no + 1) * 30000, total_ms) as end_ms from c
""")
def chunk_bounds(spark, d):
    total = views.media(spark, d).groupBy("media_id").agg(F.max("end_ms").alias("total_ms"))
    return timeline.chunk_bounds(total)


@_register(f"""
with {MEDIA}, t as (select media_id, 8000::bigint * 300 as size, max(end_ms) * 8 as n from media group by media_id),
c as (select *, unnest(range(0, cast(ceil(n / size::double) as bigint))) as chunk_no from t)
select media_id, chunk_no, chunk_no * size as first_sample, least(size, n - chunk_no * size) as n_samples from c
""")
def sample_chunks(spark, d):
    m = views.media(spark, d).groupBy("media_id").agg((F.max("end_ms") * 8).alias("n_samples")).withColumn("sample_rate", F.lit(8000))
    return timeline.sample_chunks(m)


@_register(f"with {CUES} select cue_id, start_ms * 16000 // 1000 as at_16k, least(start_ms * 44100 // 1000, 100000000) as at_44k, printf('%s_%06d_%010d_%010d.wav', track, cue_id, start_ms, end_ms) as file from cues")
def sample_positions(spark, d):
    s = F.col("start_ms")
    return views.cues(spark, d).select("cue_id", timecode.sample_index(s, F.lit(16000)).alias("at_16k"), timecode.sample_index(s, F.lit(44100), F.lit(100000000)).alias("at_44k"), languages.fragment_name(F.col("track"), F.col("cue_id"), s, F.col("end_ms")).alias("file"))


# --- audio ----------------------------------------------------------------------------------------------------------


@_register(f"""
with {CUES}, s as (select cast(user_id as varchar) as media_id, cue_id, start_ms as a, end_ms as z from cues),
p as (select media_id, a as pos from s union select media_id, z + 1 from s),
g as (select media_id, pos, lead(pos) over (partition by media_id order by pos) - 1 as till from p),
w as (select g.media_id, pos, till, max(cue_id) as value from g join s on s.media_id = g.media_id and s.a <= pos and s.z >= till group by g.media_id, pos, till),
o as (select *, case when lag(value) over v = value and lag(till) over v + 1 = pos then 0 else 1 end as opens from w window v as (partition by media_id order by pos)),
n as (select *, sum(opens) over (partition by media_id order by pos rows unbounded preceding) as k from o)
select media_id, min(pos) as first, max(till) as last, any_value(value) as value from n group by media_id, k
""")
def overlay_lww(spark, d):
    """Every cue is a span in its user's timeline, to the millisecond; later cues lie over earlier ones."""
    c = views.cues(spark, d)
    return overlay.overlay_runs(c.select(F.col("user_id").cast("string").alias("media_id"), F.col("cue_id").alias("ord"), F.col("start_ms").alias("first"), F.col("end_ms").alias("last"), F.col("cue_id").alias("value")))


#: Every cue sounds from its start to its end, at 100 Hz, over the whole time axis of its track.
_SOUND = f"""
{CUES}, s as (select track, cue_id, start_ms // 10 as first, greatest((end_ms - start_ms) // 10, 1) as n from cues),
t as (select track, max(end_ms) // 10 as total from cues group by track),
x as (select track, cue_id, first, unnest(range(0, n)) as i from s),
v as (select x.track, first + i as sample, max(cue_id) as top, arg_max((cue_id * 31 + i) % 1000, cue_id) as value from x join t on t.track = x.track and first + i < total group by x.track, first + i)
"""


def _sound(spark, d, scale=1.0):
    """Cues are dealt out before they get samples, as the table may come in few splits."""
    c = views.cues(spark, d)
    n = "greatest((end_ms - start_ms) div 10, 1)"
    pcm = F.expr(f"transform(sequence(0, {n} - 1), i -> cast((cue_id * 31 + i) % 1000 / {scale}D as float))")
    seg = c.drop("text", "user_id").repartition("cue_id").select(F.col("track").alias("media_id"), F.col("cue_id").alias("ord"), "start_ms", F.lit(100).alias("sample_rate"), pcm.alias("pcm"))
    media = c.groupBy(F.col("track").alias("media_id")).agg(F.max("end_ms").alias("total_ms")).withColumn("sample_rate", F.lit(100))
    return audio.mix_down(seg, media)


@F.pandas_udf(LongType())
def _checksum(pcm: pd.Series, first: pd.Series, scale: pd.Series) -> pd.Series:
    """Sum of samples, which times scale are whole, each times its place's remainder."""
    return pd.Series([int(np.rint(p.astype(np.float64) * s).astype(np.int64) @ ((f + np.arange(len(p))) % 1009)) for p, f, s in zip(pcm, first, scale)], dtype="int64")


@F.pandas_udf(LongType())
def _n_set(pcm: pd.Series) -> pd.Series:
    return pd.Series([np.count_nonzero(p) for p in pcm], dtype="int64")


@_register(f"""
with {_SOUND},
f as (select track, unnest(range(0, (total - 1) // {audio.FRAME} + 1)) as frame_no from t)
select f.track as media_id, frame_no, cast(coalesce(sum(value * (sample % 1009)), 0) as bigint) as total, count(*) filter (value <> 0) as n_set from f left join v on v.track = f.track and v.sample // {audio.FRAME} = f.frame_no group by f.track, frame_no
""")
def mix_down(spark, d):
    frames = _sound(spark, d)
    return frames.select("media_id", "frame_no", _checksum("pcm", F.col("frame_no") * audio.FRAME, F.lit(1)).alias("total"), _n_set("pcm").alias("n_set"))


@_register(f"""
with {_SOUND},
c as (select track, sum(cast(round(cast(value / 1000.0 as float)::double * 32767) as bigint) * (sample % 1009)) as total from v group by track)
select t.track as media_id, total as n_samples, 100 as sample_rate, cast(coalesce(c.total, 0) as bigint) as checksum from t left join c on c.track = t.track
""".replace("select t.track as media_id, total as n_samples", "select t.track as media_id, t.total as n_samples"))
def mix_to_file(spark, d):
    """The mix of every track as one WAV file, read back by byte ranges."""
    frames = _sound(spark, d, 1000.0).select("media_id", (F.col("frame_no") * audio.FRAME).alias("first_sample"), F.lit(100).alias("sample_rate"), "pcm")
    path = shared_path(spark, "mix")
    wav_files.write_wav(frames, path)
    pieces = wav_files.read_pieces(spark, path, split_bytes=1 << 20)
    media = F.url_decode(F.regexp_extract("media_id", r"([^/]*)\.wav$", 1)).alias("media_id")
    per = pieces.select(media, F.size("pcm").cast("bigint").alias("n"), "sample_rate", _checksum("pcm", "first_sample", F.lit(32768)).alias("total"))
    return per.groupBy("media_id").agg(F.sum("n").alias("n_samples"), F.max("sample_rate").alias("sample_rate"), F.sum("total").alias("checksum"))


@_register(f"""
with p as (select vec_id % 8 as m, vec_id // 8 as n, embedding as e from embeddings),
x as (select m, n * 64 + i - 1 as sample, e[i]::double as v from (select m, n, e, unnest(range(1, 65)) as i from p)),
t as (select m, count(*) as n from x group by m),
h as (select unnest({resample_.filter_bank(1000, 500)[0].tolist()}::double[]) as h, unnest(range({1 - resample_.reach(1000, 500)}, {resample_.reach(1000, 500) + 1})) as k),
y as (select x.m, (x.sample - k) // 2 as sample, sum(v * h) as y from x, h where (x.sample - k) % 2 = 0 and x.sample - k >= 0 group by x.m, (x.sample - k) // 2)
select cast(y.m as varchar) as media_id, sample, cast(floor(cast(y as float)::double * 1000) as bigint) as value from y join t on t.m = y.m where sample < t.n // 2
""")
def resample_pieces(spark, d):
    """Vectors are pieces of audio at 1 kHz, resampled to 500 Hz in blocks of another size."""
    out = resample_.resample(views.pieces(spark, d, 1000), 500, block=100)
    return out.select("media_id", "first_sample", F.posexplode("pcm")).select("media_id", (F.col("first_sample") + F.col("pos")).alias("sample"), F.floor(F.col("col").cast("double") * 1000).alias("value"))


@_register("select cast(label as varchar) as media_id, case when count(*) filter (vec_id % 50 = 49) = 0 then count(*) * 64 end as n_samples, case when count(*) filter (vec_id % 50 = 49) = 0 then md5(string_agg(array_to_string(list_transform(embedding, lambda x: cast(cast(floor(x::double * 1000) as bigint) as varchar)), ' '), ' ' order by vec_id)) end as pcm_md5 from embeddings group by label")
def chunk_concat(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("media_id"), F.col("vec_id").alias("chunk_no"), F.expr("case when vec_id % 50 <> 49 then embedding end").alias("pcm"))
    digest = F.md5(F.array_join(F.transform("pcm", lambda x: F.floor(x.cast("double") * 1000).cast("string")), " "))
    return audio.concat_chunks(e).select("media_id", F.when(F.col("pcm").isNotNull(), F.size("pcm")).cast("bigint").alias("n_samples"), digest.alias("pcm_md5"))


@_register("""
with e as (select cast(label as varchar) as media_id, vec_id as chunk_no, len(embedding) as n, vec_id % 50 = 49 and label % 2 = 1 as failed from embeddings)
select media_id, chunk_no, cast(sum(n) over (partition by media_id order by chunk_no) - n as bigint) as first_sample, n as n_samples from e
where not exists (select 1 from e f where f.failed and f.media_id is not distinct from e.media_id)
""")
def chunk_pieces(spark, d):
    """Where the chunks of media lie of which none failed: every fiftieth vector of an odd label is a failed one."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("media_id"), F.col("vec_id").alias("chunk_no"), F.expr("case when not coalesce(vec_id % 50 = 49 and label % 2 = 1, false) then embedding end").alias("pcm"))
    return audio.concat_pieces(e).select("media_id", "chunk_no", "first_sample", F.size("pcm").cast("bigint").alias("n_samples"))


@_register(f"with {CUES} select track as media_id, max(end_ms) as total_ms, count(distinct 8000 * (1 + cue_id % 3)) as n_rates, string_agg(distinct cast(8000 * (1 + cue_id % 3) as varchar), ' ' order by cast(8000 * (1 + cue_id % 3) as varchar)) as rates from cues group by track")
def media_durations(spark, d):
    c = views.cues(spark, d).select(F.col("track").alias("media_id"), "end_ms", F.expr("cast(8000 * (1 + cue_id % 3) as int)").alias("sample_rate"))
    return audio.durations(c).withColumn("rates", F.array_join(F.array_sort(F.transform("rates", lambda r: r.cast("string"))), " "))


@_register("""
with c as (select vec_id % 8 as m, vec_id // 8 as n, embedding as e from embeddings),
f as (select a.m, a.n, list_concat(a.e[18:64], coalesce(b.e[1:53], [])) as pcm from c a left join c b on b.m = a.m and b.n = a.n + 1 where a.n % 3 = 0)
select cast(m as varchar) as media_id, n // 3 as frag_id, printf('%d_%06d_%010d_%010d.wav', m, n // 3, n * 64 + 17, n * 64 + 117) as file, len(pcm) as n_samples,
  md5(array_to_string(list_transform(pcm, lambda x: cast(cast(floor(x::double * 1000) as bigint) as varchar)), ' ')) as pcm_md5 from f
""")
def fragment_cut(spark, d):
    """Each vector is a piece of audio at 1 kHz; fragments of 100 ms are cut over the pieces' borders, from chunks of another size."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 8).cast("string").alias("media_id"), F.floor(F.col("vec_id") / 8).alias("n"))
    pieces = views.pieces(spark, d, 1000)
    start = F.col("n") * 64 + 17
    spans = e.where("n % 3 = 0").select("media_id", F.floor(F.col("n") / 3).alias("frag_id"), start.alias("start_ms"), (start + 100).alias("end_ms"))
    digest = F.md5(F.array_join(F.transform("pcm", lambda x: F.floor(x.cast("double") * 1000).cast("string")), " "))
    return segment.cut_fragments(pieces, spans, chunk_ms=150).select("media_id", "frag_id", "file", F.size("pcm").cast("bigint").alias("n_samples"), digest.alias("pcm_md5"))


@_register("""
with p as (select vec_id % 8 as m, vec_id // 8 as n, embedding as e from embeddings),
loud as (select m, n, i - 1 as i from (select m, n, e, unnest(range(1, 65)) as i from p) where abs(e[i]) > cast(0.15 as float)),
b as (select *, case when i - lag(i) over w - 1 < 5 then 0 else 1 end as opens from loud window w as (partition by m, n order by i)),
k as (select *, sum(opens) over (partition by m, n order by i rows unbounded preceding) as k from b),
seg as (select m, n, n * 640 + min(i) * 10 as s, n * 640 + (max(i) + 1) * 10 as e from k group by m, n, k having (max(i) + 1 - min(i)) * 10 >= 50),
o as (select *, case when lag(n) over w + 1 = n and abs(lag(e) over w - n * 640) < 100 and s - n * 640 < 500 then 0 else 1 end as opens from seg window w as (partition by m order by s, e)),
g as (select *, sum(opens) over (partition by m order by s, e rows unbounded preceding) - 1 as frag_id from o)
select cast(m as varchar) as media_id, frag_id, min(s) as start_ms, max(e) as end_ms, count(*) as n_parts from g group by m, frag_id
""")
def segment_audio(spark, d):
    """Vectors are audio at 100 Hz: chunks, detector and stitching in one go. Where an entry is large, there is sound."""
    return segment.segment_audio(views.pieces(spark, d, 100), EnergyVad(threshold=0.15, min_speech_ms=50, min_silence_ms=50), chunk_ms=640)


# --- refinement -----------------------------------------------------------------------------------------------------


@_register(f"with {CALLS} select track, call_seq, name, pos from calls where pos <> 0 and (name = 'this_is_fine' or name = 'this_should_be' and first_text <> '' and second_text <> '')")
def valid_calls(spark, d):
    return refine.valid_calls(views.calls(spark, d)).select("track", "call_seq", "name", "pos")


_APPLIED = f"""
{STATE}, {CALLS},
valid as (select * from calls where pos <> 0 and (name = 'this_is_fine' or name = 'this_should_be' and first_text <> '' and second_text <> '')),
per as (select track, pos, arg_max(first_text, call_seq) filter (name = 'this_should_be') as f, arg_max(second_text, call_seq) filter (name = 'this_should_be') as s from valid group by track, pos),
applied as (select s.track, s.pos, case when p.pos is not null then 'finished' else s.state end as state, case when p.f is not null then p.s || chr(10) || p.f else s.text end as text, p.f as first_text, p.s as second_text
  from state s left join per p on p.track = s.track and p.pos = s.pos)
"""


@_register(f"with {_APPLIED} select * from applied")
def apply_calls(spark, d):
    return refine.apply_calls(views.state(spark, d), views.calls(spark, d)).select("track", "pos", "state", "text", "first_text", "second_text")


@_register(f"""
with {_APPLIED}
select track, count(*) as total, count(*) filter (state = 'finished') as finished, count(first_text) as refined, coalesce(min(pos) filter (state = 'unfinished'), -1) as first_unfinished, round(100.0 * count(first_text) / count(*), 1) as refined_percent
from applied group by track
""")
def refine_progress(spark, d):
    return refine.progress(refine.apply_calls(views.state(spark, d), views.calls(spark, d)))


@_register(f"""
with {_APPLIED},
p as (select track, count(*) as total, min(pos) filter (state = 'unfinished') as f from applied group by track),
b as (select track, f, case when greatest(f - 5, 1) + 9 > total then greatest(total - 9, 1) else greatest(f - 5, 1) end as a, least(greatest(f - 5, 1) + 9, total) as z from p where f is not null)
select b.track, a as win_start, z as win_end, f as first_unfinished, count(*) filter (pos < f and state = 'finished') as context_count, count(*) filter (state = 'unfinished') as unfinished_count
from b join applied s on s.track = b.track and pos between a and z group by b.track, a, z, f
""")
def refine_windows(spark, d):
    return refine.windows(refine.apply_calls(views.state(spark, d), views.calls(spark, d)), 10)


@_register(f"with {CUES}, n as (select track, row_number() over (partition by track order by start_ms, cue_id) as pos from cues) select track, pos, case when pos <= 10 then 1 else 2 + (pos - 11) // 5 end as round_no from n")
def window_schedule(spark, d):
    n = cues.number_cues(views.cues(spark, d), "pos")
    return n.select("track", "pos", refine.schedule_round(F.col("pos"), 10).alias("round_no"))


@_register(f"""
with {STATE}, e as (select track, (pos - 1) // 10 as win, pos, 'Subtitle #' || pos || ':' || chr(10) || '  Target: ' || track || chr(10) || '  Source: ' || pos || chr(10) as t from state)
select track, win, string_agg(t, chr(10) order by pos) as prompt from e group by track, win
""")
def window_text(spark, d):
    return refine.window_text(views.state(spark, d).withColumn("win", F.floor((F.col("pos") - 1) / 10)))


@_register(f"""
with {STATE}, f as (select track, min(pos) filter (state = 'unfinished') as f from state group by track)
select track, pos, '  ' || case state when 'finished' then '✓' else '○' end || ' [' || pos || '] ' || track || ' | ' || pos || case when pos = f then ' ← CENTER' else '' end as line from state join f using (track)
""")
def window_display(spark, d):
    s = views.state(spark, d)
    first = refine.progress(s).select("track", "first_unfinished")
    return refine.window_display(s.join(first, "track").withColumn("is_center", F.col("pos") == F.col("first_unfinished")))


@_register(f"""
with {STATE}
select track, pos, 'finished' as state, case when state = 'finished' or pos % 5 = 0 then text else 'second ' || pos || chr(10) || 'first ' || pos end as text from state
""")
def refine_logged(spark, d):
    """All tracks refined in windows of a third of the longest, by a scripted service that keeps every fifth cue and changes the others."""
    state = views.state(spark, d)

    def ask(entries, retry):
        keep = F.col("pos") % 5 == 0
        rows = entries.where("state = 'unfinished'").select("track", "pos", F.col("pos").alias("call_seq"), F.when(keep, refine.KEEP).otherwise(refine.CHANGE).alias("name"))
        text = lambda t: F.when(F.col("name") == refine.CHANGE, F.concat(F.lit(t), F.col("pos").cast("string")))
        return rows.withColumns({"first_text": text("first "), "second_text": text("second ")})

    longest = state.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    log = call_log.CallLog(spark, shared_path(spark, "log"), "events")
    out, _ = refine.refine_logged(state, ask, log, refine.Config(window=longest // 3 + 2, checkpoint_every=2))
    return out.select("track", "pos", "state", "text")


class _Labels:
    """A service that names a user's kind of event."""

    def healthy(self):
        return True

    def call(self, requests):
        return [{"label": f"{r['event_type'].upper()}:{r['user_id']}"} for r in requests]


@_register("select event_id, upper(event_type) || ':' || user_id as label, cast(event_type = 'click' as int) as first_run from events")
def calls_paid_once(spark, d):
    """Two runs over one store: clicks first, as if the run had been lost there, then all events; equal requests are one call."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    ask = lambda rows: paid_once.call_once(rows, _Labels(), "labels", ["event_type", "user_id"], "label string", store)
    store = shared_path(spark, "answers")
    clicks = ask(e.where("event_type = 'click'")).select(F.col("event_id").alias("_id"))
    return ask(e).join(clicks, F.col("event_id") == F.col("_id"), "left").select("event_id", "label", F.col("_id").isNotNull().cast("int").alias("first_run"))


@_register(f"""
with {CALLS} select track, call_seq, name, pos, case when name = 'this_should_be' then first_text end as first_text, case when name = 'this_should_be' then second_text end as second_text from calls
""")
def tool_calls(spark, d):
    """Calls written as a model's answer, one answer of one call per event, and read again."""
    c = views.calls(spark, d)
    change = F.col("name") == "this_should_be"
    given = F.struct(F.col("pos").alias(tools.ID), F.when(change, F.col("first_text")).alias(tools.FIRST), F.when(change, F.col("second_text")).alias(tools.SECOND))
    answers = c.select("track", F.col("call_seq").alias("round"), F.to_json(F.array(F.struct("name", given.alias("arguments")))).alias("answer"))
    return tools.calls_of(answers).withColumn("call_seq", F.floor(F.col("call_seq") / (1 << 32)))


@_register("select r_regionkey, r_name, unnest(range(3, 8)) as speaker_id from region")
def speaker_grid(spark, d):
    return grid.speaker_grid(table(spark, d, "region").select("r_regionkey", "r_name"), 3, 7)


@_register("""
select event_type, count(*) as total, count(*) filter (value > 100) as succeeded, count(*) filter (not value > 100) as failed,
  round(100.0 * count(*) filter (value > 100) / count(*), 1) as success_percent, floor(avg(cast(floor(value) as bigint)))::bigint as mean_ms
from events group by event_type
""")
def run_summary(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") > 100).alias("ok"), F.floor("value").alias("ms"))
    return grid.run_summary(e, ("event_type",))
