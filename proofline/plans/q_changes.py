"""Change sets: hunks, blocks and points from user events; patches and line versions from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv, snapshots as sn
from ..sources.changes import explode_patch
from .base import Derived, query, table

MINUTE = "cast(extract(day from ts) as bigint) * 1440 + cast(extract(hour from ts) as bigint) * 60 + cast(extract(minute from ts) as bigint)"
# a user is a file and a minute a line; an error changes as many lines as its value says, none being a pure deletion
HUNKS = Derived(f"""
    select 'user/' || cast(user_id as string) as path, {MINUTE} as new_start, cast(floor(value / 4) as bigint) as new_len,
           cast(floor(value / 3) as bigint) as removed_len, cast(floor(value / 4) as bigint) as added_len
    from {{events}} where event_type = 'error'""")
BLOCKS = Derived(f"""
    select event_id as id, 'user/' || cast(user_id as string) as path, {MINUTE} as block_start, {MINUTE} + cast(floor(value) as bigint) as block_end
    from {{events}} where event_type in ('purchase', 'view')""")
POINTS = Derived(f"""
    select event_id as id, 'user/' || case when value < 5 then 'gone' else cast(user_id as string) end as path,
           case when value > 60 then null else {MINUTE} end as line, case when value < 10 then 'left' when value < 50 then 'right' else 'file' end as side,
           case when event_type = 'signup' then 'old' when event_type = 'click' then 'new' end as version, value > 50 as outdated from {{events}}""")
CHANGES = dict(hunks=HUNKS, blocks=BLOCKS, points=POINTS)
FIRST = "case when h.new_len = 0 then h.new_start + 1 else h.new_start + h.new_len - 1 end"


@query("j11_interval_overlap", f"""
    select b.id, exists (select 1 from hunks h where h.path = b.path and h.new_start <= b.block_end and {FIRST} >= b.block_start) as touched from blocks b""", **CHANGES)
def _(spark, sf):
    return iv.interval_overlap(BLOCKS(spark, sf), HUNKS(spark, sf)).select("id", "touched")


INSIDE_NEW = "exists (select 1 from hunks h where h.path = p.path and h.new_len > 0 and p.line between h.new_start and h.new_start + h.new_len - 1)"
INSIDE_OLD = "exists (select 1 from hunks h where h.path = p.path and h.removed_len > 0 and p.line between greatest(h.new_start, 1) and greatest(h.new_start, 1) + h.removed_len - 1)"


@query("j12_point_in_interval", f"select id, {INSIDE_NEW} as in_new, {INSIDE_OLD} as in_old from points p", **CHANGES)
def _(spark, sf):
    hunks = HUNKS(spark, sf)
    out = iv.point_in_interval(POINTS(spark, sf), hunks, name="in_new")
    return iv.point_in_interval(out, hunks, side="old", name="in_old").select("id", "in_new", "in_old")


@query("j13_anchor_points", f"""
    with s as (select p.*, case when outdated or coalesce(version <> 'new', false) or line is null then 'outdated'
      when path not in (select path from hunks) then 'path_absent' else 'resolved' end as outcome from points p)
    select id, outcome, case when outcome = 'resolved' then case side when 'right' then {INSIDE_NEW} when 'left' then {INSIDE_OLD} else false end end as within from s p""",
       **CHANGES)
def _(spark, sf):
    hunks = HUNKS(spark, sf)
    return iv.anchor_points(POINTS(spark, sf), hunks, hunks.select("path"), version="new").select("id", "outcome", "within")


@query("w4_first_interval", """
    select c.user_id as id, 'user/' || c.user_id as path, min(greatest(h.new_start, 1)) as line,
      arg_min(case when h.new_len > 0 then 'new' else 'old' end, (greatest(h.new_start, 1), h.new_len = 0)) as side
    from (select distinct user_id from events) c join hunks h on h.path = 'user/' || c.user_id group by 1, 2""", **CHANGES)
def _(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("user/"), "user_id").alias("path")).distinct()
    return iv.first_interval(users, HUNKS(spark, sf))


@query("a14_change_size", """
    select c_custkey as id, cast(coalesce(sum(added_len), 0) as bigint) as lines_added, cast(coalesce(sum(removed_len), 0) as bigint) as lines_removed
    from customer left join hunks on path = 'user/' || c_custkey group by 1""", **CHANGES)
def _(spark, sf):
    entities = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("user/"), "c_custkey").alias("path"))
    return iv.change_size(entities, HUNKS(spark, sf))


@query("d17_refine_changed", f"""
    select event_id as id from events e left join blocks b on b.id = e.event_id where b.id is null
      or exists (select 1 from hunks h where h.path = b.path and h.new_start <= b.block_end and {FIRST} >= b.block_start)""", **CHANGES)
def _(spark, sf):
    changed = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return sn.refine_changed(changed, BLOCKS(spark, sf), HUNKS(spark, sf))


# one patch per document: its first line replaced by the whole text, then a pure deletion; some files are new, gone or renamed
PATCHES = Derived("""
    select doc_id as doc, 'diff --git a/./src/' || cast(doc_id as string) || '.txt b/src/' || cast(doc_id as string) || '.txt' || chr(10) ||
      case when lang = 'de' then 'rename from old/' || cast(doc_id as string) || '.txt' || chr(10) || 'rename to src/' || cast(doc_id as string) || '.txt' || chr(10) else '' end ||
      case when lang = 'fr' then '--- /dev/null' else '--- a/src/' || cast(doc_id as string) || '.txt' end || chr(10) ||
      case when lang = 'es' then '+++ /dev/null' else '+++ b/./src//' || cast(doc_id as string) || '.txt' end || chr(10) ||
      '@@ -1 +' || cast(n_chars as string) || ',' || cast(length(text) - length(replace(text, chr(10), '')) + 1 as string) || ' @@ ctx' || chr(10) ||
      '-' || split_part(text, chr(10), 1) || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') || chr(10) ||
      '@@ -9,2 +7,0 @@' || chr(10) || '-gone' || chr(10) || '-too' as text from {documents}""")
LINES = "length(text) - length(replace(text, chr(10), '')) + 1"


@query("s5_read_change_hunks", f"""
    select doc_id as doc, 'src/' || doc_id || '.txt' as path, 0 as hunk, cast(n_chars as int) as new_start, cast({LINES} as int) as new_len,
      cast({LINES} as int) as added_len, 1 as removed_len from documents where lang <> 'es'
    union all select doc_id, 'src/' || doc_id || '.txt', 1, 7, 0, 0, 2 from documents where lang <> 'es'""")
def _(spark, sf):
    return explode_patch(PATCHES(spark, sf)).hunks


@query("s5_read_change_files", """
    select doc_id as doc, 'src/' || doc_id || '.txt' as path, case when lang = 'de' then 'old/' || doc_id || '.txt' end as old_path,
      case lang when 'de' then 'renamed' when 'fr' then 'added' when 'es' then 'deleted' else 'modified' end as status from documents""")
def _(spark, sf):
    return explode_patch(PATCHES(spark, sf)).files


@query("s5_read_change_lines", """
    with live as (select * from documents where lang <> 'es')
    select doc_id as doc, 'added' as side, unnest(string_split(text, chr(10))) as text from live
    union all select doc_id, 'removed', split_part(text, chr(10), 1) from live union all select doc_id, 'removed', 'gone' from live
    union all select doc_id, 'removed', 'too' from live""")
def _(spark, sf):
    return explode_patch(PATCHES(spark, sf)).lines.select("doc", "side", "text")


# plain patches of two files each: a removed line "-- old" meets an added line "++ new" where a hunk ends
PLAIN = Derived("""
    select doc_id as doc, '--- a/src/' || cast(doc_id as string) || '.sql' || chr(10) || '+++ b/src/' || cast(doc_id as string) || '.sql' || chr(10) ||
      '@@ -1,2 +1,' || cast(length(text) - length(replace(text, chr(10), '')) + 2 as string) || ' @@' || chr(10) || '-gone' || chr(10) ||
      case when lang = 'en' then '+' || replace(text, chr(10), chr(10) || '+') || chr(10) || '--- old' || chr(10) || '+++ new'
        else '--- old' || chr(10) || '+++ new' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+') end || chr(10) ||
      '@@ -9 +20 @@' || chr(10) || '-' || source || chr(10) || '+' || lang || chr(10) ||
      case when lang = 'fr' then 'Index: x' || chr(10) else '' end ||
      '--- a/etc/' || cast(doc_id as string) || chr(9) || '2024' || chr(10) || '+++ b/etc/' || cast(doc_id as string) || chr(10) ||
      '@@ -3,1 +4,0 @@' || chr(10) || '--- last' || chr(10) || '@@ -5,2 +5,1 @@' || chr(10) || ' same' || chr(10) || '-x' as text from {documents}""")


@query("s5_plain_patch_comment", f"""
    select doc_id as doc, 'src/' || doc_id || '.sql' as path, 0 as hunk, 1 as new_start, cast({LINES} + 1 as int) as new_len,
      cast({LINES} + 1 as int) as added_len, 2 as removed_len from documents
    union all select doc_id, 'src/' || doc_id || '.sql', 1, 20, 1, 1, 1 from documents
    union all select doc_id, 'etc/' || doc_id, 0, 4, 0, 0, 1 from documents union all select doc_id, 'etc/' || doc_id, 1, 5, 1, 0, 1 from documents""")
def _(spark, sf):
    return explode_patch(PLAIN(spark, sf)).hunks


NEW_TEXT = Derived("""
    select doc_id, case when lang = 'en' then replace(text, 'the ', 'one ') when lang = 'fr' then text || chr(10) || source else text end as text from {documents}""")


@query("d16_line_delta", """
    with o as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), n as (select doc_id, unnest(string_split(text, chr(10))) as line from new_text),
    c as (select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(n.k, 0) - coalesce(o.k, 0) as d
      from (select doc_id, line, count(*) as k from o group by 1, 2) o full join (select doc_id, line, count(*) as k from n group by 1, 2) n
      on n.doc_id = o.doc_id and n.line = o.line)
    select doc_id, cast(sum(greatest(d, 0)) as bigint) as lines_added, cast(sum(greatest(-d, 0)) as bigint) as lines_removed from c group by 1""", new_text=NEW_TEXT)
def _(spark, sf):
    return sn.line_delta(table(spark, sf, "documents").select("doc_id", "text"), NEW_TEXT(spark, sf), "doc_id", "text")
