"""DuckDB oracle SQL, one statement per registered query.

Written from the behaviour description, not from the Spark expressions: the
point is an independent second implementation. Views ``region nation ...
conversations`` are registered by the caller over the same parquet files.
"""

from __future__ import annotations

from ..config import CHARS_PER_TOKEN, DEFAULT_SYSTEM_PROMPT
from ..operators.messages import system_tokens
from .queries import TEST_BUDGET, TEST_PAGE_CHARS

ORACLE: dict[str, str] = {}


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SYS = sql_str(DEFAULT_SYSTEM_PROMPT)
SYS_TOK = system_tokens(DEFAULT_SYSTEM_PROMPT)
TOK = f"cast(ceil(length(text) / {CHARS_PER_TOKEN}.0) as bigint)"

ORACLE["role_normalize"] = """
select case when role = 'user' then 'user' else 'assistant' end as role,
       count(*) as n_messages, cast(sum(length(text)) as bigint) as n_chars
from conversations group by 1
"""

ORACLE["conversation_tokens"] = f"""
select conv_id, count(*) as n_turns, cast(sum({TOK}) as bigint) as turn_tokens,
       cast({SYS_TOK} as bigint) as system_tokens
from conversations group by conv_id
"""

ORACLE["truncate_context"] = f"""
with m as (
  select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role,
         text as content, {TOK} as tokens,
         row_number() over (partition by conv_id order by turn) as rn,
         count(*) over (partition by conv_id) as n,
         coalesce(sum({TOK}) over (partition by conv_id), 0) as total
  from conversations)
select conv_id, cast(turn as bigint) as turn, role, content, tokens from m
where total <= {TEST_BUDGET - SYS_TOK} or rn > ceil(n / 2.0)
union all
select distinct conv_id, cast(-1 as bigint), 'system', {SYS}, cast({SYS_TOK} as bigint) from conversations
"""


# -- command parsing ---------------------------------------------------------
# RE2 (DuckDB) patterns written for JavaScript semantics: W is the JavaScript
# whitespace class, \z the end of input; (?m)^ in RE2 starts lines after \n only,
# which is all the driver data contains.
W_IN = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
W = f"[{W_IN}]"


def trim_js(x: str) -> str:
    return rf"regexp_replace({x}, '\A{W}+|{W}+\z', '', 'g')"


def unesc(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '''\"''\"''', ''''), "
        r"'\n', chr(10)), '\t', chr(9)), '\''', ''''), '\\', '\')"
    )


COMPLETIONS_SQL_T = """
b as (
 select l_orderkey, l_linenumber,
   (l_orderkey * 7 + l_linenumber) % 10 as shape,
   '/src/f' || cast(l_orderkey // 15 as varchar) || '.py' as active_path,
   case when l_linenumber % 4 = 0 then '/src/other.py'
        else '/src/f' || cast(l_orderkey // 15 as varchar) || '.py' end as target0,
   cast(1 + l_suppkey % 40 as integer) as line_count,
   cast(l_suppkey % 7 as integer) as last_line_len,
   1 + l_orderkey % 45 as s0, 1 + l_orderkey % 45 + l_linenumber as e0,
   'x = ' || cast(l_partkey as varchar) as pay
 from {src}),
c0 as (
 select *, case shape
  when 0 then 'sed -i ' || chr(39) || cast(s0 as varchar) || ',' || cast(e0 as varchar) || 'd' || chr(39) || ' ' || target0
  when 1 then 'sed -i ' || chr(39) || cast(s0 as varchar) || ',' || cast(e0 as varchar) || 'c' || chr(92) || chr(10) || pay || chr(39) || ' ' || target0
  when 2 then 'sed -E -i ' || chr(39) || cast(s0 as varchar) || 'i' || chr(92) || chr(10) || pay || chr(92) || 'n' || chr(39) || ' ' || target0 || ' && cat -n ' || target0
  when 3 then 'sed -i ' || chr(39) || '$a' || chr(92) || chr(10) || pay || chr(39) || ' ' || target0
  when 4 then 'cat -n ' || target0
  when 5 then 'cat -n ' || target0 || ' | sed -n ' || chr(39) || cast(s0 as varchar) || ',' || cast(e0 as varchar) || 'p' || chr(39)
  when 6 then '-A ls ' || chr(92) || chr(92) || 'n ' || pay || chr(92) || 't'
  when 7 then 'sed -i ' || chr(39) || cast(s0 as varchar) || ',' || cast(e0 as varchar) || 'c' || chr(92) || chr(10) || 'a && ' || pay || chr(39) || ' ' || target0
  when 8 then '<think>' || pay || '</think> pytest -k ' || cast(l_orderkey as varchar)
  else '' end as cmd0 from b),
completions as (
 select l_orderkey, l_linenumber, active_path, line_count, last_line_len, shape,
  case when l_linenumber % 3 = 0 then cmd0
       when l_linenumber % 3 = 1 then 'Plan.' || chr(10) || '```bash' || chr(10) || cmd0 || chr(10) || '```'
       else '```' || chr(10) || cmd0 || chr(10) || '```' || chr(10) || 'done' end as raw
 from c0)"""
COMPLETIONS_SQL = COMPLETIONS_SQL_T.replace("{src}", "lineitem")

FENCE_RE = rf"(?is)```(?:bash)?{W}*(.*?)```"
SED_RE = rf"(?s)sed{W}+(?:-[A-Za-z]+{W}+)*-i{W}+(?:-[A-Za-z]+{W}+)*''(.*?)''{W}+([^{W_IN}&|]+){W}*\z"
DEL_RE = r"\A(\d+),(\d+)d\z"
REP_RE = r"(?s)\A(\d+),(\d+)c\\\n(.*)\z"
INS_RE = r"(?s)\A(\d+)i\\\n(.*)\z"
APP_RE = r"(?s)\A\$a\\\n(.*)\z"
CAT_RE = rf"\Acat{W}+-n{W}+([^{W_IN}|]+){W}*\z"
SLICE_RE = rf"\Acat{W}+-n{W}+([^{W_IN}|]+){W}*\|{W}*sed{W}+-n{W}+''(\d+),(\d+)p''{W}*\z"


def grp(x: str, pat: str, i: int) -> str:
    return f"case when regexp_matches({x}, '{pat}') then regexp_extract({x}, '{pat}', {i}) end"


def parse_chain(src: str) -> str:
    """CTEs from a relation with (raw, active_path, line_count, last_line_len)
    to one with the parsed action flattened into columns."""
    fence = grp("t", FENCE_RE, 1)
    return f"""
p1 as (select *, {trim_js('raw')} as t from {src}),
p2 as (select *, case when length(raw) > 0 then coalesce(nullif({fence}, ''), nullif(t, '')) end as command from p1),
p3 as (select *, nullif({trim_js("regexp_replace(command, '(?is)<think>.*?</think>', '', 'g')")}, '') as cmd from p2),
p4 as (select *, {trim_js(r"string_split_regex(cmd, '&&|\|\|')[1]")} as main from p3),
p5 as (select *, case when active_path is not null and length(main) > 0
                       and {grp('main', SED_RE, 2)} = active_path then {grp('main', SED_RE, 1)} end as script,
              case when active_path is not null and length(main) > 0 then {grp('main', CAT_RE, 1)} end as cat_file,
              case when active_path is not null and length(main) > 0 then {grp('main', SLICE_RE, 1)} end as slice_file,
              try_cast({grp('main', SLICE_RE, 2)} as integer) as vs,
              try_cast({grp('main', SLICE_RE, 3)} as integer) as ve
       from p4),
p6 as (select *,
   case when regexp_matches(script, '{DEL_RE}') and try_cast(regexp_extract(script, '{DEL_RE}', 1) as integer) is not null
             and try_cast(regexp_extract(script, '{DEL_RE}', 2) as integer) is not null then 'delete'
        when regexp_matches(script, '{REP_RE}') and try_cast(regexp_extract(script, '{REP_RE}', 1) as integer) is not null
             and try_cast(regexp_extract(script, '{REP_RE}', 2) as integer) is not null then 'replace'
        when regexp_matches(script, '{INS_RE}') and try_cast(regexp_extract(script, '{INS_RE}', 1) as integer) is not null then 'insert'
        when regexp_matches(script, '{APP_RE}') then 'append' end as form
   from p5),
p7 as (select *,
   case form when 'delete' then try_cast(regexp_extract(script, '{DEL_RE}', 1) as bigint)
             when 'replace' then try_cast(regexp_extract(script, '{REP_RE}', 1) as bigint)
             when 'insert' then try_cast(regexp_extract(script, '{INS_RE}', 1) as bigint) end as a1,
   case form when 'delete' then try_cast(regexp_extract(script, '{DEL_RE}', 2) as bigint)
             when 'replace' then try_cast(regexp_extract(script, '{REP_RE}', 2) as bigint) end as a2,
   case form when 'replace' then {unesc(f"regexp_extract(script, '{REP_RE}', 3)")}
             when 'insert' then {unesc(f"regexp_extract(script, '{INS_RE}', 2)")}
             when 'append' then {unesc(f"regexp_extract(script, '{APP_RE}', 1)")} end as payload,
   greatest(0, floor((cast(vs as bigint) + cast(ve as bigint)) / 2) - 1) as center0
   from p6),
p8 as (select *,
   case when a2 is null then null
        when greatest(0, a2 - 1) + 1 >= line_count then line_count - 1 else greatest(0, a2 - 1) + 1 end as el,
   case when a2 is null then null
        when greatest(0, a2 - 1) + 1 >= line_count then last_line_len else 0 end as ec,
   case when payload is null then null when suffix(payload, chr(10)) then payload else payload || chr(10) end as ptext
   from p7),
parsed as (select *,
   case when cmd is null then null
        when form = 'delete' then 'editDelete'
        when form = 'replace' then 'editReplace'
        when form in ('insert', 'append') then 'editInsert'
        when cat_file is not null then case when cat_file <> active_path then 'openFile' else 'showTextDocument' end
        when slice_file is not null and vs is not null and ve is not null then
             case when slice_file <> active_path then 'openFile' else 'setSelections' end
        else 'terminalSendText' end as kind,
   cast(case when cmd is null then null
        when form in ('delete', 'replace', 'insert') then greatest(0, a1 - 1)
        when form = 'append' then line_count
        when cat_file is not null then null
        when slice_file is not null and vs is not null and ve is not null then
             case when slice_file <> active_path then center0 else least(center0, greatest(0, line_count - 1)) end
        end as bigint) as line,
   cast(case when cmd is null then null
        when form is not null then 0
        when cat_file is not null then null
        when slice_file is not null and vs is not null and ve is not null then 0 end as bigint) as ch,
   cast(case when form in ('delete', 'replace') then el end as bigint) as end_line,
   cast(case when form in ('delete', 'replace') then ec end as bigint) as end_ch,
   case when cmd is null then null
        when form in ('replace', 'insert') then ptext
        when form = 'append' then case when line_count > 0 then chr(10) || ptext else ptext end
        when form = 'delete' then null
        when cat_file is not null or (slice_file is not null and vs is not null and ve is not null) then null
        else {trim_js(r"replace(replace(replace(replace(regexp_replace(cmd, '(?m)^-[A-Z]" + W + r"*', '', 'g'), '''" + '"' + "''" + '"' + r"''', ''''), '\\', '\'), '\n', chr(10)), '\t', chr(9))")}
        end as text,
   case when cmd is null or form is not null then null
        when cat_file is not null then case when cat_file <> active_path then cat_file end
        when slice_file is not null and vs is not null and ve is not null then
             case when slice_file <> active_path then slice_file end end as file_path
   from p8)"""


ACTION_COLS = "kind, line, ch, end_line, end_ch, text, file_path"

ORACLE["extract_command"] = f"with {COMPLETIONS_SQL}, {parse_chain('completions')} select l_orderkey, l_linenumber, command from parsed"
ORACLE["strip_think"] = f"with {COMPLETIONS_SQL}, {parse_chain('completions')} select l_orderkey, l_linenumber, cmd as command from parsed"
ORACLE["sanitize_command"] = f"""with {COMPLETIONS_SQL}, {parse_chain('completions')}
select l_orderkey, l_linenumber,
  {trim_js(r"replace(replace(replace(replace(regexp_replace(cmd, '(?m)^-[A-Z]" + W + r"*', '', 'g'), '''" + '"' + "''" + '"' + r"''', ''''), '\\', '\'), '\n', chr(10)), '\t', chr(9))")} as command
from parsed"""
for _form in ("delete", "replace", "insert", "append"):
    ORACLE[f"parse_edit_{_form}"] = (
        f"with {COMPLETIONS_SQL}, {parse_chain('completions')} "
        f"select l_orderkey, l_linenumber, {ACTION_COLS} from parsed where form = '{_form}'"
    )
ORACLE["parse_view"] = (
    f"with {COMPLETIONS_SQL}, {parse_chain('completions')} select l_orderkey, l_linenumber, {ACTION_COLS} "
    "from parsed where form is null and kind in ('openFile', 'showTextDocument', 'setSelections')"
)
ORACLE["route_action"] = f"with {COMPLETIONS_SQL}, {parse_chain('completions')} select l_orderkey, l_linenumber, {ACTION_COLS} from parsed"
ORACLE["action_mix"] = (
    f"with {COMPLETIONS_SQL}, {parse_chain('completions')} "
    "select coalesce(kind, 'none') as kind, count(*) as n from parsed group by 1"
)
ORACLE["action_doc_join"] = f"""with {COMPLETIONS_SQL},
docs as (select '/src/f' || cast(doc_id as varchar) || '.py' as path,
                cast(len(string_split_regex(text, '\\r\\n|\\n|\\r')) as integer) as line_count,
                cast(length(string_split_regex(text, '\\r\\n|\\n|\\r')[-1]) as integer) as last_line_len
         from documents),
cj as (select c.l_orderkey, c.l_linenumber, c.active_path, c.raw, d.line_count, d.last_line_len
       from completions c left join docs d on c.active_path = d.path),
{parse_chain('cj')}
select l_orderkey, l_linenumber, line_count, last_line_len, {ACTION_COLS} from parsed"""


# -- responses ------------------------------------------------------------
RESPONSES_SQL = f"""
first_li as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey from (
    select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn
    from lineitem) where rn = 1),
{COMPLETIONS_SQL_T.replace("{src}", "first_li")},
toks as (
  select l_orderkey as request_id,
         list(struct_pack(logprob := (-25 * round(l_discount * 100)) / 100.0) order by l_linenumber) as lp
  from lineitem group by l_orderkey),
first_c as (select l_orderkey as request_id, raw, active_path, line_count, last_line_len
            from completions),
r0 as (
  select o.o_orderkey as request_id, 'model-' || substr(o.o_orderpriority, 1, 1) as model_name,
         coalesce(t.lp, []::struct(logprob double)[]) as lp, f.raw, f.active_path, f.line_count, f.last_line_len
  from orders o left join toks t on t.request_id = o.o_orderkey left join first_c f on f.request_id = o.o_orderkey),
responses as (
  select request_id, model_name, active_path, line_count, last_line_len,
    case request_id % 20
      when 0 then json_object('choices', json_array(json_object('text', raw, 'logprobs', json_object('content', lp))))::varchar
      when 1 then json_object('choices', json_array(json_object('message', json_object('content', 5), 'logprobs', json_object('content', lp))))::varchar
      when 2 then json_object('choices', json_array(json_object('message', json_object('content', '  '), 'logprobs', json_object('content', lp))))::varchar
      when 3 then json_object('choices', json_array(json_object('message', json_object('content', raw))))::varchar
      when 4 then '{{"id":' || cast(request_id as varchar) || '}}'
      when 5 then 'not json ' || cast(request_id as varchar)
      else json_object('choices', json_array(json_object('message', json_object('content', raw), 'logprobs', json_object('content', lp))))::varchar
    end as body
  from r0),
scored0 as (
  select *, json_valid(body) as valid from responses),
scored1 as (
  select *,
    case when valid and json_type(body, '$.choices[0].logprobs.content') = 'ARRAY'
         then list_transform(json_extract(body, '$.choices[0].logprobs.content[*].logprob'), lambda x: cast(x as double)) end as lps,
    case when valid and json_type(body, '$.choices[0].message.content') = 'VARCHAR' then json_extract_string(body, '$.choices[0].message.content')
         when valid and json_type(body, '$.choices[0].text') = 'VARCHAR' then json_extract_string(body, '$.choices[0].text') end as text
  from scored0),
scored as (
  select *, cast(len(lps) as bigint) as n_tokens,
    case when lps is null then null when len(lps) = 0 then 'nan'::double
         else list_reduce(list_prepend(0.0::double, lps), lambda a, x: a + x) / len(lps) end as avg_lp
  from scored1),
pre as (
  select *, case when lps is null then 'bad_response'
                 when not isnan(avg_lp) and avg_lp < -1.0 then 'low_confidence'
                 when text is null or length({trim_js('text')}) = 0 then 'empty_content' end as pre_status
  from scored),
resp_in as (select request_id, model_name, pre_status, active_path, line_count, last_line_len,
                   case when pre_status is null then text end as raw from pre)"""

AVG_OUT = "case when not isnan(avg_lp) then round(avg_lp, 6) end as avg_logprob"

ORACLE["response_text"] = f"with {RESPONSES_SQL} select request_id, text from scored"
ORACLE["avg_logprob"] = f"with {RESPONSES_SQL} select request_id, n_tokens, {AVG_OUT} from scored"
ORACLE["response_logprob"] = """
select l_orderkey as request_id, count(*) as n_tokens,
       round(avg(-25 * round(l_discount * 100)) / 100, 6) as avg_logprob
from lineitem group by l_orderkey"""
ORACLE["confidence_gate"] = (
    f"with {RESPONSES_SQL} select request_id, {AVG_OUT} from scored "
    "where avg_lp is not null and (isnan(avg_lp) or avg_lp >= -1.0)"
)
ORACLE["parse_status"] = f"""with {RESPONSES_SQL}, {parse_chain('resp_in')}
select request_id, model_name,
       coalesce(pre_status, case when kind is null then 'no_action' else 'ok' end) as parse_status, kind
from parsed"""


# -- session state ----------------------------------------------------------
SESSION_SQL = """
sev as (
  select user_id, (epoch_us(ts) // 1000) as ts, event_id as seq, value,
    case event_type when 'view' then 'shown' when 'purchase' then 'accept'
         when 'error' then case when event_id % 3 = 1 then 'dismiss' else 'reject' end
         when 'click' then case event_id % 5 when 3 then 'selection' when 4 then 'content' else 'tab' end
         when 'signup' then case when event_id % 2 = 0 then 'clear' else 'toggle' end end as kind,
    event_id % 11 <> 0 as has_editor, event_id % 13 <> 0 as focused,
    case when event_type = 'click'
         then '/src/f' || cast(user_id * 7 + cast(json_extract(props, '$.k') as bigint) % 20 as varchar) || '.py' end as file
  from events),
st0 as (
  select *,
    sum(case when kind = 'clear' then 1 else 0 end) over w as epoch,
    sum(case when kind = 'toggle' then 1 else 0 end) over w % 2 = 0 as enabled
  from sev window w as (partition by user_id order by ts, seq rows between unbounded preceding and current row)),
st1 as (
  select *, case when kind in ('reject', 'dismiss') then true
                 when kind = 'toggle' and not enabled then true
                 when kind in ('selection', 'tab', 'content') then false end as flag
  from st0),
st as (
  select *, coalesce(last_value(flag ignore nulls) over (partition by user_id order by ts, seq
                     rows between unbounded preceding and current row), false) as suppressed
  from st1),
docs_len as (select '/src/f' || cast(doc_id as varchar) || '.py' as file, cast(length(text) as bigint) as doc_chars
             from documents)"""

ORACLE["context_epoch"] = f"with {SESSION_SQL} select user_id, seq, kind, cast(epoch as bigint) as epoch from st"
ORACLE["suppress_state"] = (
    f"with {SESSION_SQL} select user_id, seq, kind, cast(epoch as bigint) as epoch, enabled, suppressed from st"
)
# The session's first tab event: the file active at its start.
_WITH_START = SESSION_SQL.replace(
    "\n  from events),",
    """
  from events
  union all
  select user_id, min(epoch_us(ts) // 1000), -1, null, 'tab', null, null, '/src/f' || cast(user_id * 7 as varchar) || '.py'
  from events group by user_id),""",
    1,
)
ORACLE["first_activation"] = f"""with {_WITH_START},
t as (select *, row_number() over (partition by user_id, epoch, file order by ts, seq) = 1 as is_first
      from st where kind = 'tab')
select t.user_id, t.seq, t.file, cast(t.epoch as bigint) as epoch, t.is_first,
       d.text, cast(length(d.text) as bigint) as n_chars
from t left join documents d on t.is_first and t.file = '/src/f' || cast(d.doc_id as varchar) || '.py'"""
ORACLE["trigger_gate"] = f"""with {SESSION_SQL}
select s.user_id, s.seq, s.enabled, s.suppressed,
       s.enabled and not s.suppressed and s.has_editor and s.focused and coalesce(d.doc_chars, 0) > 0 as passes
from st s left join docs_len d on d.file = s.file where s.kind in ('selection', 'tab', 'content')"""
ORACLE["latest_wins"] = f"""with {SESSION_SQL},
r as (select user_id, seq, ts, ts + cast(round(value * 100000) as bigint) as response_ts from sev where kind = 'shown')
select user_id, seq, ts, response_ts, next_request_ts,
       next_request_ts is null or next_request_ts > response_ts as was_shown
from (select *, lead(ts) over (partition by user_id order by ts, seq) as next_request_ts from r)"""
ORACLE["outcome_resolve"] = """
with d as (
  select user_id, (epoch_us(ts) // 1000) as ts, event_id as seq,
         case event_type when 'view' then 'shown' when 'purchase' then 'accept' when 'error' then 'reject' end as kind
  from events where event_type in ('view', 'purchase', 'error')),
n as (select *, sum(case when kind = 'shown' then 1 else 0 end)
                  over (partition by user_id order by ts, seq rows between unbounded preceding and current row) as g
      from d),
shown as (select user_id, g, ts as shown_ts, seq as shown_seq,
                 lead(ts) over (partition by user_id order by ts, seq) as next_shown_ts
          from n where kind = 'shown'),
firstd as (select user_id, g, arg_min(kind, (ts, seq)) as dkind, min(ts) as dts
           from n where kind <> 'shown' and g > 0 group by user_id, g)
select s.user_id, s.shown_seq, s.shown_ts,
       case when f.dkind = 'accept' then 'accepted' when f.dkind = 'reject' then 'rejected' else 'ignored' end as outcome,
       coalesce(f.dts, s.next_shown_ts) as outcome_ts
from shown s left join firstd f on f.user_id = s.user_id and f.g = s.g
where f.dkind is not null or s.next_shown_ts is not null"""


# -- preference samples -------------------------------------------------------
SAMPLES_SQL = f"""{RESPONSES_SQL}, {parse_chain('resp_in')},
pstat as (
  select p.request_id, p.model_name, p.raw, p.kind, p.line, p.ch, p.end_line, p.end_ch, p.text as atext, p.file_path,
         s.avg_lp, coalesce(p.pre_status, case when p.kind is null then 'no_action' else 'ok' end) as status
  from parsed p join scored s on s.request_id = p.request_id),
ev as (select user_id, (epoch_us(ts) // 1000) as ts, event_id as seq, event_type from events),
shown as (
  select v.user_id, v.ts, v.seq, p.raw, p.kind, p.line, p.ch, p.end_line, p.end_ch, p.atext, p.file_path,
         p.avg_lp, p.model_name
  from ev v join pstat p on p.request_id = v.seq where v.event_type = 'view' and p.status = 'ok'),
dec as (
  select user_id, ts, seq, 'shown' as dk from shown
  union all
  select user_id, ts, seq, case event_type when 'purchase' then 'accept' else 'reject' end from ev
  where event_type in ('purchase', 'error')),
dn as (select *, sum(case when dk = 'shown' then 1 else 0 end)
                   over (partition by user_id order by ts, seq rows between unbounded preceding and current row) as g
       from dec),
sg as (select user_id, g, ts as shown_ts, seq as shown_seq,
              lead(ts) over (partition by user_id order by ts, seq) as next_shown_ts
       from dn where dk = 'shown'),
fd as (select user_id, g, arg_min(dk, (ts, seq)) as dkind, min(ts) as dts
       from dn where dk <> 'shown' and g > 0 group by user_id, g),
outc as (
  select s.user_id, s.shown_seq, s.shown_ts,
         case when f.dkind = 'accept' then 'accepted' when f.dkind = 'reject' then 'rejected' else 'ignored' end as outcome,
         coalesce(f.dts, s.next_shown_ts) as outcome_ts
  from sg s left join fd f on f.user_id = s.user_id and f.g = s.g
  where f.dkind is not null or s.next_shown_ts is not null),
tm as (
  select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role, text as content,
         row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n,
         coalesce(sum({TOK}) over (partition by conv_id), 0) as total
  from conversations),
tk as (
  select conv_id, turn, role, content from tm where total <= {120000 - SYS_TOK} or rn > ceil(n / 2.0)
  union all
  select distinct conv_id, -1, 'system', {SYS} from conversations),
ctx as (select conv_id, list(struct_pack(role := role, content := content) order by turn) as context
        from tk group by conv_id),
samples as (
  select o.user_id, o.shown_seq as sample_id, o.shown_ts as timestamp, o.outcome, o.outcome_ts as outcomeTimestamp,
         s.model_name as modelName, s.raw, s.kind, s.line, s.ch, s.end_line, s.end_ch, s.atext, s.file_path,
         s.avg_lp, coalesce(c.context, []) as context
  from outc o join shown s on s.seq = o.shown_seq left join ctx c on c.conv_id = o.user_id)"""

ORACLE["outcome_report"] = f"""with {SAMPLES_SQL}
select modelName as model_name, kind,
       case when not isnan(avg_lp) then floor(avg_lp / 0.25) * 0.25 end as lp_bucket,
       count(*) as n,
       cast(sum(case when outcome = 'accepted' then 1 else 0 end) as bigint) as n_accepted,
       cast(sum(case when outcome = 'rejected' then 1 else 0 end) as bigint) as n_rejected,
       cast(sum(case when outcome = 'ignored' then 1 else 0 end) as bigint) as n_ignored,
       case when sum(case when outcome in ('accepted', 'rejected') then 1 else 0 end) > 0
            then round(sum(case when outcome = 'accepted' then 1 else 0 end)
                       / sum(case when outcome in ('accepted', 'rejected') then 1 else 0 end), 6) end as acceptance_rate,
       round(sum(outcomeTimestamp - timestamp) / count(*), 3) as avg_latency_ms,
       min(outcomeTimestamp - timestamp) as min_latency_ms,
       list_sort(list(outcomeTimestamp - timestamp))[(count(*) * 50 + 99) // 100] as p50_latency_ms,
       list_sort(list(outcomeTimestamp - timestamp))[(count(*) * 95 + 99) // 100] as p95_latency_ms,
       max(outcomeTimestamp - timestamp) as max_latency_ms
from samples group by 1, 2, 3"""

ORACLE["preference_log_roundtrip"] = f"""with {SAMPLES_SQL}
select timestamp, outcome, outcomeTimestamp, modelName, cast(len(context) as bigint) as n_context,
       kind, line, ch, end_line, end_ch, atext as text, file_path,
       case when not isnan(avg_lp) then round(avg_lp, 6) end as avg_logprob, raw
from samples"""

ORACLE["reward_labels"] = f"""with {SAMPLES_SQL},
lab as (select *, case outcome when 'accepted' then 1 when 'rejected' then 0 end as label from samples),
m as (select min(struct_pack(ts := timestamp, id := sample_id, label := label)) as m
      from lab where label is not null group by context, raw)
select m.id as sample_id, m.ts as timestamp, cast(m.label as integer) as label from m"""

ORACLE["dpo_pairs"] = f"""with {SAMPLES_SQL},
d as (select *, coalesce(
         last_value(case when outcome = 'accepted' then sample_id end ignore nulls)
                  over (partition by context order by timestamp, sample_id
                        rows between unbounded preceding and current row),
         first_value(case when outcome = 'accepted' then sample_id end ignore nulls)
                  over (partition by context order by timestamp, sample_id
                        rows between current row and unbounded following)) as chosen_id
      from samples where outcome in ('accepted', 'rejected'))
select chosen_id, sample_id as rejected_id from d where outcome = 'rejected' and chosen_id is not null"""


# -- positions, edits, viewports (documents hold \n line ends only) -----------
NL = "chr(10)"


def start_of(lines: str, line: str) -> str:
    return f"(case when {line} <= 0 then 0 else length(array_to_string(list_slice({lines}, 1, {line}), {NL})) + 1 end)"


def offset_sql(text: str, lines: str, line: str, ch: str) -> str:
    return (
        f"(case when {line} < 0 then 0 when {line} >= len({lines}) then length({text}) "
        f"else {start_of(lines, line)} + least(greatest({ch}, 0), length({lines}[{line} + 1])) end)"
    )


ORACLE["offset_to_position"] = """
with d as (select doc_id, text, cast(floor(length(text) / 2) as bigint) as o_mid, cast(length(text) as bigint) as o_end
           from documents)
select doc_id,
  cast(length(left(text, o_mid)) - length(replace(left(text, o_mid), chr(10), '')) as bigint) as line_mid,
  cast(o_mid - length(regexp_extract(left(text, o_mid), '(?s)^.*\\n', 0)) as bigint) as ch_mid,
  cast(length(text) - length(replace(text, chr(10), '')) as bigint) as line_end,
  cast(o_end - length(regexp_extract(text, '(?s)^.*\\n', 0)) as bigint) as ch_end
from d""".replace("\\\\n", "\\n")

ORACLE["position_to_offset"] = f"""
with d as (select doc_id, text, string_split(text, {NL}) as ls from documents),
e as (select *, cast(floor(len(ls) / 2) as integer) as l_mid, len(ls) + 5 as l_past from d)
select doc_id,
  cast({offset_sql('text', 'ls', 'l_mid', '3')} as bigint) as off_mid,
  cast({offset_sql('text', 'ls', 'l_past', '0')} as bigint) as off_past,
  cast({offset_sql('text', 'ls', '1', '1000000')} as bigint) as off_clamp
from e"""

# Every character with the UTF-16 units and code points before it.
ORACLE["utf16_positions"] = """
with d as (select doc_id, replace(text, 'o', chr(128512)) as text from documents),
p as (select doc_id, unnest(string_split(text, '')) as c, unnest(range(0, length(text))) as i, text from d where length(text) > 0),
u as (select *, 1 + (unicode(c) > 65535)::int as w from p),
r as (select *, sum(w) over (partition by doc_id order by i) - w as pre, sum(w) over (partition by doc_id) as n from u),
m as (select doc_id, cast(any_value(n) as bigint) as n_units,
             max(i) filter (pre <= n // 2) as points, max(pre) filter (pre <= n // 2) as pre,
             count(*) filter (c = chr(10) and pre < n // 2) as line,
             max(pre + 1) filter (c = chr(10) and pre < n // 2) as line_start
      from r group by doc_id)
select doc_id, n_units, points, line, cast(pre - coalesce(line_start, 0) as bigint) as ch, cast(pre as bigint) as back from m
union all select doc_id, 0, 0, 0, 0, 0 from d where length(text) = 0"""


def collapse_sql(x: str) -> str:
    return trim_js(f"regexp_replace({x}, '{W}+', ' ', 'g')")


def applied_sql(kind: str) -> str:
    return f"""with {COMPLETIONS_SQL},
docs as (select '/src/f' || cast(doc_id as varchar) || '.py' as path, text,
                cast(len(string_split_regex(text, '\\r\\n|\\n|\\r')) as integer) as line_count,
                cast(length(string_split_regex(text, '\\r\\n|\\n|\\r')[-1]) as integer) as last_line_len
         from documents),
cj as (select c.l_orderkey, c.l_linenumber, c.active_path, c.raw, d.line_count, d.last_line_len
       from completions c join docs d on c.active_path = d.path),
{parse_chain('cj')},
ap as (select p.l_orderkey, p.l_linenumber, p.kind, p.line, p.ch, p.end_line, p.end_ch, p.text as ins, d.text as t,
              string_split(d.text, {NL}) as ls
       from parsed p join docs d on d.path = p.active_path where p.form is not null and p.kind = '{kind}'),
offs as (select *, {offset_sql('t', 'ls', 'line', 'ch')} as o1, {offset_sql('t', 'ls', 'end_line', 'end_ch')} as o2 from ap),
res as (select *, case when kind = 'editInsert' then left(t, o1) || ins || substr(t, o1 + 1)
                       when kind = 'editDelete' then left(t, least(o1, o2)) || substr(t, greatest(o1, o2) + 1)
                       else left(t, least(o1, o2)) || ins || substr(t, greatest(o1, o2) + 1) end as nt from offs)
select l_orderkey, l_linenumber, cast(length(nt) as bigint) as new_len, md5(nt) as new_md5,
       t <> nt and {collapse_sql('t')} <> {collapse_sql('nt')} as significant
from res"""


ORACLE["apply_insert"] = applied_sql("editInsert")
ORACLE["apply_delete"] = applied_sql("editDelete")
ORACLE["apply_replace"] = applied_sql("editReplace")

ORACLE["viewport_lines"] = f"""
with d as (select doc_id, string_split(text, {NL}) as ls from documents),
e as (select *, greatest(cast(floor(len(ls) / 2) as integer) - 10, 0) as first from d)
select doc_id, cast(first + i as bigint) as line_no, cast(length(ls[first + i + 1]) as bigint) as line_len,
       md5(ls[first + i + 1]) as line_md5
from e, range(0, 21) r(i) where first + i < len(ls)"""


# -- display strings -----------------------------------------------------
def trunc_sql(x: str, n: int) -> str:
    one = f"regexp_replace({x}, '\\r?\\n', '↵', 'g')"
    return f"(case when length({one}) <= {n} then {one} else left({one}, {n - 1}) || '…' end)"


ORACLE["truncate_text"] = f"""
select conv_id, turn, {trunc_sql('text', 60)} as t60,
       {trunc_sql("replace(replace(text, chr(10), '↵'), chr(9), '→')", 80)} as d80
from conversations"""

BASE_SQL = "coalesce(nullif(string_split_regex(file_path, '[/\\\\]')[-1], ''), file_path)"

ORACLE["path_basename"] = (
    f"with {COMPLETIONS_SQL}, {parse_chain('completions')} "
    f"select l_orderkey, l_linenumber, {BASE_SQL} as base_name from parsed where kind = 'openFile'"
)


def l1(x: str) -> str:
    return f"cast({x} + 1 as varchar)"


DISPLAY = {
    "summary": f"""case kind when 'terminalSendText' then 'Run terminal command'
      when 'openFile' then 'Open file: ' || {BASE_SQL}
      when 'setSelections' then 'Move cursor to line ' || {l1('line')}
      when 'editInsert' then 'Insert text' when 'editReplace' then 'Replace text'
      when 'editDelete' then 'Delete lines ' || {l1('line')} || '–' || {l1('end_line')}
      when 'terminalShow' then 'Show terminal' when 'showTextDocument' then 'Show document'
      else 'Execute action' end""",
    "detail": f"""case kind when 'terminalSendText' then text
      when 'openFile' then case when line is not null then file_path || ':' || {l1('line')} else file_path end
      when 'setSelections' then 'Line ' || {l1('line')} || ', Column ' || {l1('ch')}
      when 'editInsert' then {trunc_sql('text', 200)} when 'editReplace' then {trunc_sql('text', 200)}
      when 'editDelete' then 'Lines ' || {l1('line')} || ' to ' || {l1('end_line')}
      else '' end""",
    "label": f"""case kind when 'terminalSendText' then 'Run: ' || {trunc_sql('text', 60)}
      when 'openFile' then case when line is not null then 'Open: ' || {BASE_SQL} || ':' || {l1('line')}
                                else 'Open: ' || {BASE_SQL} end
      when 'setSelections' then case when line <= 20 then 'Move cursor here' else 'Go to line ' || {l1('line')} end
      end""",
}
DESC = {
    "terminalSendText": ("Terminal Command", "text", "Press Tab to execute, Esc to dismiss"),
    "openFile": (
        "Open File",
        f"'`' || file_path || '`' || case when line is not null then ' at line ' || {l1('line')} else '' end",
        "Press Tab to open, Esc to dismiss",
    ),
    "setSelections": ("Move Cursor", f"'Go to line ' || {l1('line')}", "Press Tab to move, Esc to dismiss"),
    "editInsert": ("Insert Text", "text", "Press Tab to insert, Esc to dismiss"),
    "editReplace": ("Replace Text", "text", "Press Tab to replace, Esc to dismiss"),
    "editDelete": ("Delete Text", f"'Lines ' || {l1('line')} || '–' || {l1('end_line')}", "Press Tab to delete, Esc to dismiss"),
}


def _desc(i: int) -> str:
    whens = " ".join(
        f"when '{k}' then " + (f"'{v[i]}'" if i != 1 else v[1]) for k, v in DESC.items()
    )
    return f"case kind {whens} end"


_PARSED = f"with {COMPLETIONS_SQL}, {parse_chain('completions')} select l_orderkey, l_linenumber"
ORACLE["action_summary"] = f"{_PARSED}, {DISPLAY['summary']} as summary from parsed"
ORACLE["action_detail"] = f"{_PARSED}, {DISPLAY['detail']} as detail from parsed"
ORACLE["action_label"] = f"{_PARSED}, {DISPLAY['label']} as label from parsed"
ORACLE["action_description"] = (
    f"{_PARSED}, {_desc(0)} as title, {_desc(1)} as body, {_desc(2)} as hint from parsed"
)


# Streams must equal their batch forms on the same input.
ORACLE["stream_outcomes"] = ORACLE["outcome_resolve"]
ORACLE["stream_first_activation"] = f"""with {SESSION_SQL}
select user_id, seq, file, cast(epoch as bigint) as epoch,
       row_number() over (partition by user_id, epoch, file order by ts, seq) = 1 as is_first
from st where kind = 'tab'"""


# -- event sources, transcripts, state as of, request bodies -------------------
FEEDS_SQL = """
ev0 as (select user_id, (epoch_us(ts) // 1000) as ts, event_id as seq, event_type,
               cast(json_extract(props, '$.k') as bigint) as k from events),
eu as (
  select user_id, min(ts) as ts, -1 as seq, 'tab' as kind, '/src/f' || cast(user_id * 7 as varchar) || '.py' as file,
         null::integer as "offset", null::integer as length, null::varchar as text, null::bigint as execution_id, null::bigint as change_idx
  from ev0 where event_type in ('view', 'click', 'purchase', 'error', 'signup') group by user_id
  union all
  select user_id, ts, seq, 'selection', '/src/f' || cast(user_id * 7 + k % 20 as varchar) || '.py', cast(k as integer), null, null, null, null
  from ev0 where event_type = 'view' and seq % 5 <> 0
  union all
  select user_id, ts, seq, 'tab', '/src/f' || cast(user_id * 7 + k % 20 as varchar) || '.py', null, null, null, null, null
  from ev0 where event_type = 'click'
  union all
  select user_id, ts, seq, 'content', '/src/f' || cast(user_id * 7 + k % 20 as varchar) || '.py', cast((seq + j) % 20 as integer), cast(j as integer), 'c' || cast(j as varchar), null, j
  from ev0, range(0, 3) r(j) where event_type = 'purchase' and seq % 4 <> 0 and j <= seq % 3
  union all
  select user_id, ts, seq, 'terminal_command', null, null, null, 'pytest -k ' || cast(k as varchar), seq, null
  from ev0 where event_type = 'error'
  union all
  select user_id, ts, seq, 'terminal_output', null, null, null, 'ok ' || cast(k as varchar) || chr(10), null, null
  from ev0 where event_type = 'signup')"""

ORACLE["event_union"] = f"""with {FEEDS_SQL},
e as (select *, kind = 'tab' and row_number() over (partition by user_id, kind, file order by ts, seq) = 1 as is_first from eu)
select user_id, ts, cast(seq as bigint) as seq, kind, file, "offset", length, case when kind = 'tab' then d.text else e.text end as text,
       execution_id, change_idx
from e left join documents d on e.is_first and e.file = '/src/f' || cast(d.doc_id as varchar) || '.py'"""

ORACLE["stream_event_union"] = ORACLE["event_union"]
ORACLE["stream_latest_wins"] = f"select user_id, seq, ts, response_ts, was_shown from ({ORACLE['latest_wins']})"

ORACLE["explode_changes"] = f"""with {FEEDS_SQL}
select user_id, seq, cast(j as bigint) as change_idx, cast((seq + j) % 20 as bigint) as "offset",
       cast(j as bigint) as length, 'c' || cast(j as varchar) as text
from ev0, range(0, 3) r(j) where event_type = 'purchase' and seq % 4 <> 0 and j <= seq % 3"""

ORACLE["replay_edits"] = f"""with recursive {FEEDS_SQL},
ed as (select file, "offset" as o, length as n, text as t, row_number() over (partition by file order by ts, seq, change_idx) as i
       from eu where kind = 'content'),
base as (select f.file, coalesce(d.text, '') as text from (select distinct file from ed) f
         left join documents d on f.file = '/src/f' || cast(d.doc_id as varchar) || '.py'),
run(file, i, text) as (
  select file, 0::bigint, text from base
  union all
  select r.file, r.i + 1, left(r.text, e.o) || e.t || substr(r.text, least(e.o, length(r.text)) + e.n + 1)
  from run r join ed e on e.file = r.file and e.i = r.i + 1)
select file, max(i) as n_edits, cast(length(arg_max(text, i)) as bigint) as n_chars, md5(arg_max(text, i)) as text_md5
from run group by file"""

ORACLE["terminal_transcript"] = f"""with {FEEDS_SQL},
t as (select *, last_value(case when kind = 'terminal_command' then execution_id end ignore nulls)
                 over (partition by user_id order by ts, seq rows between unbounded preceding and current row) as xid
      from eu where kind in ('terminal_command', 'terminal_output'))
select xid as execution_id, count(*) as n_chunks, string_agg(text, '' order by ts, seq) as transcript
from t where kind = 'terminal_output' and xid is not null group by xid"""

ORACLE["transcript_pages"] = f"""with {FEEDS_SQL},
t as (select *, last_value(case when kind = 'terminal_command' then execution_id end ignore nulls)
                 over (partition by user_id order by ts, seq rows between unbounded preceding and current row) as xid
      from eu where kind in ('terminal_command', 'terminal_output')),
c as (select xid, ts, seq, text, coalesce(sum(length(text)) over (partition by xid order by ts, seq
                 rows between unbounded preceding and 1 preceding), 0) as pre
      from t where kind = 'terminal_output' and xid is not null),
whole as (select xid, string_agg(text, '' order by ts, seq) as txt from c group by xid),
pages as (select xid, unnest(range(0, cast(ceil(length(txt) / {TEST_PAGE_CHARS}.0) as bigint))) as page, txt from whole),
starts as (select xid, cast(floor(pre / {TEST_PAGE_CHARS}) as bigint) as page, count(*) as n from c group by all)
select xid as execution_id, page, coalesce(n, 0) as n_chunks,
       substring(txt, page * {TEST_PAGE_CHARS} + 1, {TEST_PAGE_CHARS}) as text
from pages left join starts using (xid, page)"""

ORACLE["session_state_asof"] = f"""with {SAMPLES_SQL},
acc as (select user_id, outcomeTimestamp as ts, sample_id as seq, kind, line, file_path, atext
        from samples where outcome = 'accepted'),
w as (select *,
   last_value(case when kind = 'openFile' then file_path end ignore nulls) over x as active_file,
   (last_value(case when kind = 'openFile' or (kind = 'setSelections' and line is not null)
                    then struct_pack(l := line) end ignore nulls) over x).l as cursor_line,
   last_value(case when kind = 'terminalSendText' then atext end ignore nulls) over x as terminal_text
 from acc window x as (partition by user_id order by ts, seq rows between unbounded preceding and current row))
select user_id, seq, kind, active_file, cursor_line, terminal_text from w"""

ORACLE["request_build"] = f"""
with m as (
  select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role, text as content,
         {TOK} as tokens,
         row_number() over (partition by conv_id order by turn) as rn, count(*) over (partition by conv_id) as n,
         coalesce(sum({TOK}) over (partition by conv_id), 0) as total
  from conversations),
k as (select conv_id, turn, role, content, tokens from m where total <= {TEST_BUDGET - SYS_TOK} or rn > ceil(n / 2.0)
      union all select distinct conv_id, -1, 'system', {SYS}, {SYS_TOK} from conversations)
select conv_id, count(*) as n_messages, cast(sum(tokens) as bigint) as request_tokens,
       cast(sum(length(content)) as bigint) as content_chars,
       arg_min(role, turn) as first_role, arg_max(role, turn) as last_role,
       sha256(string_agg(concat_ws(':', role, content), chr(10) order by turn)) as messages_sha256,
       'qwen/qwen3-8b' as model, 0.7::double as temperature, 0.8::double as top_p, 20::bigint as top_k,
       0::double as min_p, true as logprobs, false as enable_thinking
from k group by conv_id"""

ORACLE["stream_actions"] = ORACLE["route_action"]
ORACLE["stream_preference_log"] = ORACLE["preference_log_roundtrip"]


# -- revision diffs ------------------------------------------------------------
# Pairs: the whole replaced range of a document (a) against the replacement (b).
# L comes from the LCS table built one row per character of a (recursive CTE);
# the alignment is recovered by backtracking that table (match first, then up
# when the cell above is strictly larger, else left), and segments follow from
# the leftmost embedding of the LCS string in a and in b: between consecutive
# matched characters lie one deleted run and one inserted run.
REVISION_PAIRS_SQL = f"""{COMPLETIONS_SQL},
docs as (select '/src/f' || cast(doc_id as varchar) || '.py' as path, text,
                cast(len(string_split_regex(text, '\\r\\n|\\n|\\r')) as integer) as line_count,
                cast(length(string_split_regex(text, '\\r\\n|\\n|\\r')[-1]) as integer) as last_line_len
         from documents),
cj as (select c.l_orderkey, c.l_linenumber, c.active_path, c.raw, d.line_count, d.last_line_len
       from completions c join docs d on c.active_path = d.path),
{parse_chain('cj')},
ap as (select p.l_orderkey, p.l_linenumber, p.line, p.ch, p.end_line, p.end_ch, p.text as ins, d.text as t,
              string_split(d.text, {NL}) as ls
       from parsed p join docs d on d.path = p.active_path where p.form is not null and p.kind = 'editReplace'),
offs as (select *, {offset_sql('t', 'ls', 'line', 'ch')} as o1, {offset_sql('t', 'ls', 'end_line', 'end_ch')} as o2 from ap),
pairs as (select row_number() over () as pid, l_orderkey, l_linenumber, t, ls, least(o1, o2) as range_start,
                 substr(t, least(o1, o2) + 1, abs(o2 - o1)) as a, ins as b from offs),
dp(pid, i, r) as (
  select pid, 0, list_transform(range(0, length(b) + 1), lambda j: 0) from pairs
  union all
  select d.pid, d.i + 1,
         list_reduce(range(1, length(p.b) + 1),
                     lambda acc, j: list_append(acc, case when substr(p.a, d.i + 1, 1) = substr(p.b, j, 1)
                                                          then d.r[j] + 1 else greatest(d.r[j + 1], acc[j]) end),
                     [0])
  from dp d join pairs p on p.pid = d.pid where d.i < length(p.a))"""

DIFF_SQL = f"""{REVISION_PAIRS_SQL},
bt(pid, i, j, lcs) as (
  select pid, length(a), length(b), '' from pairs
  union all
  select b0.pid,
    case when substr(p.a, b0.i, 1) = substr(p.b, b0.j, 1) or d1.r[b0.j + 1] > d0.r[b0.j] then b0.i - 1 else b0.i end,
    case when substr(p.a, b0.i, 1) = substr(p.b, b0.j, 1) or not (d1.r[b0.j + 1] > d0.r[b0.j]) then b0.j - 1 else b0.j end,
    case when substr(p.a, b0.i, 1) = substr(p.b, b0.j, 1) then substr(p.a, b0.i, 1) || b0.lcs else b0.lcs end
  from bt b0 join pairs p on p.pid = b0.pid
       join dp d0 on d0.pid = b0.pid and d0.i = b0.i
       join dp d1 on d1.pid = b0.pid and d1.i = b0.i - 1
  where b0.i > 0 and b0.j > 0),
lcs as (select pid, lcs from bt where i = 0 or j = 0),
emb(pid, k, po, pn) as (
  select pid, 0, 0, 0 from lcs
  union all
  select e.pid, e.k + 1,
         e.po + instr(substr(p.a, e.po + 1), substr(l.lcs, e.k + 1, 1)),
         e.pn + instr(substr(p.b, e.pn + 1), substr(l.lcs, e.k + 1, 1))
  from emb e join lcs l on l.pid = e.pid join pairs p on p.pid = e.pid where e.k < length(l.lcs)),
gaps as (
  -- gap k (1..L+1) lies before matched character k (k = L+1: the tail)
  select p.pid, e.k + 1 as k,
         e.po as del_start,
         coalesce(n.po - 1, length(p.a)) as del_end,
         substr(p.b, e.pn + 1, coalesce(n.pn - 1, length(p.b)) - e.pn) as ins
  from emb e join pairs p on p.pid = e.pid
       left join emb n on n.pid = e.pid and n.k = e.k + 1),
facts as (
  select p.pid, p.l_orderkey, p.l_linenumber, p.t, p.range_start, p.a, p.b,
    count(*) filter (where g.del_end > g.del_start or length(g.ins) > 0) as regions,
    count(*) filter (where length(g.ins) > 0) as ins_regions,
    bool_or(g.del_end > g.del_start) as has_del,
    bool_or(length({trim_js('g.ins')}) > 0) as nonblank_ins,
    arg_min(g.del_start, g.k) filter (where g.del_end > g.del_start or length(g.ins) > 0) as c_start,
    arg_min(g.del_end, g.k) filter (where g.del_end > g.del_start or length(g.ins) > 0) as c_end,
    arg_min(g.ins, g.k) filter (where g.del_end > g.del_start or length(g.ins) > 0) as c_text
  from pairs p join gaps g on g.pid = p.pid
  group by p.pid, p.l_orderkey, p.l_linenumber, p.t, p.range_start, p.a, p.b)"""


def pos_line(text: str, off: str) -> str:
    return f"cast(length(left({text}, {off})) - length(replace(left({text}, {off}), chr(10), '')) as bigint)"


def pos_ch(text: str, off: str) -> str:
    return f"cast({off} - length(regexp_extract(left({text}, {off}), '(?s)^.*\\n', 0)) as bigint)"


ORACLE["diff_regions"] = f"with recursive {DIFF_SQL} select l_orderkey, l_linenumber, cast(regions as bigint) as regions from facts"
ORACLE["diff_flags"] = f"""with recursive {DIFF_SQL}
select l_orderkey, l_linenumber, has_del as has_deletion, length(b) > 0 and nonblank_ins as has_insertions from facts"""
ORACLE["coherent_replacement"] = f"""with recursive {DIFF_SQL},
c as (select *, regions = 1 and has_del and length(c_text) > 0 as ok from facts)
select l_orderkey, l_linenumber, ok as is_coherent,
  case when ok then {pos_line('t', 'range_start + c_start')} end as del_start_line,
  case when ok then {pos_ch('t', 'range_start + c_start')} end as del_start_ch,
  case when ok then {pos_line('t', 'range_start + c_end')} end as del_end_line,
  case when ok then {pos_ch('t', 'range_start + c_end')} end as del_end_ch,
  case when ok then c_text end as text
from c"""
ORACLE["pure_insertion"] = f"""with recursive {DIFF_SQL},
c as (select *, not has_del and ins_regions = 1 and length(c_text) > 0 as ok from facts)
select l_orderkey, l_linenumber, ok as is_pure,
  case when ok then {pos_line('t', 'range_start + c_start')} end as line,
  case when ok then {pos_ch('t', 'range_start + c_start')} end as ch,
  case when ok then c_text end as text
from c"""
ORACLE["deletion_ranges"] = f"""with recursive {DIFF_SQL},
d as (select p.l_orderkey, p.l_linenumber, p.t, p.range_start, g.del_start, g.del_end,
             row_number() over (partition by g.pid order by g.k) as idx
      from gaps g join pairs p on p.pid = g.pid where g.del_end > g.del_start)
select l_orderkey, l_linenumber, cast(idx as bigint) as idx,
  {pos_line('t', 'range_start + del_start')} as start_line, {pos_ch('t', 'range_start + del_start')} as start_ch,
  {pos_line('t', 'range_start + del_end')} as end_line, {pos_ch('t', 'range_start + del_end')} as end_ch
from d"""
ORACLE["revision_diff_totals"] = f"""with recursive {REVISION_PAIRS_SQL}
select p.l_orderkey, p.l_linenumber,
       cast(d.r[-1] as bigint) as equal_chars,
       cast(length(p.a) - d.r[-1] as bigint) as delete_chars,
       cast(length(p.b) - d.r[-1] as bigint) as insert_chars
from pairs p join dp d on d.pid = p.pid and d.i = length(p.a)"""

ORACLE["preview_class"] = f"""with recursive {DIFF_SQL},
rep as (select l_orderkey, l_linenumber, 'editReplace' as kind,
               case when not has_del and ins_regions = 1 and length(c_text) > 0 then 'inline_insertion'
                    when length(b) > 0 and nonblank_ins and regions = 1 and has_del and length(c_text) > 0 then 'coherent_inline'
                    when length(b) > 0 and nonblank_ins then 'replace_block'
                    when not has_del and length(a) > 0 then 'whole_range'
                    else 'deletion_only' end as preview_class
        from facts),
oth as (select l_orderkey, l_linenumber, kind,
               case when kind = 'editInsert' then
                         case when line > floor(line_count / 2) or (line = floor(line_count / 2) and ch >= 0)
                              then 'ghost' else 'insert_block' end
                    when kind = 'editDelete' then 'range_delete'
                    when kind in ('terminalSendText', 'setSelections', 'openFile') then 'indicator'
                    when kind in ('terminalShow', 'showTextDocument') then 'none' end as preview_class
        from parsed where not (form is not null and kind = 'editReplace') or kind is null)
select * from rep union all select * from oth"""


# -- trigger coalescing: a per-user step-by-step simulation (recursive CTE over
# each user's events in order; state = pending timers + last fire time).
_PEND_T = "struct(seq bigint, t bigint, f bigint)"
_OUT_T = "struct(seq bigint, t bigint, fire bigint, cancelled boolean)"
ORACLE["coalesce_triggers"] = f"""with recursive
ev as (select user_id, (epoch_us(ts) // 1000) // 100000 as t, event_id as seq,
              row_number() over (partition by user_id order by (epoch_us(ts) // 1000) // 100000, event_id) as k
       from events),
sim(user_id, k, pending, last_fire, out) as (
  select user_id, 0, []::{_PEND_T}[], null::bigint, []::{_OUT_T}[] from (select distinct user_id from ev)
  union all
  select user_id, k, 
         case when len(np) > 2 then np[2:] else np end,
         lf,
         list_concat(out0, case when len(np) > 2
                                then [struct_pack(seq := np[1].seq, t := np[1].t, fire := null::bigint, cancelled := true)]
                                else []::{_OUT_T}[] end)
  from (
    select user_id, k, lf, out0,
           list_append(rest, struct_pack(seq := eseq, t := et,
                f := et + case when lf is not null and et - lf < 300 then greatest(150, 300 - (et - lf)) else 150 end)) as np
    from (
      select s.user_id, s.k + 1 as k, e.t as et, e.seq as eseq,
             list_filter(s.pending, lambda p: p.f > e.t) as rest,
             coalesce(list_max(list_transform(list_filter(s.pending, lambda p: p.f <= e.t), lambda p: p.f)), s.last_fire) as lf,
             list_concat(s.out, list_transform(list_filter(s.pending, lambda p: p.f <= e.t),
                         lambda p: struct_pack(seq := p.seq, t := p.t, fire := p.f, cancelled := false))) as out0
      from sim s join ev e on e.user_id = s.user_id and e.k = s.k + 1))),
fin as (
  select s.user_id,
         list_concat(s.out, list_transform(s.pending,
                     lambda p: struct_pack(seq := p.seq, t := p.t, fire := p.f, cancelled := false))) as res
  from sim s join (select user_id, max(k) as n from ev group by user_id) m on m.user_id = s.user_id and s.k = m.n)
select user_id, r.seq as seq, r.t as t, r.fire as fire_at, r.cancelled as cancelled
from (select user_id, unnest(res) as r from fin)"""

# The stream resolves a timer once the watermark (latest event time, no delay)
# has passed it; timers at or after the last event time are still pending.
ORACLE["stream_coalesce_triggers"] = f"""with c as ({ORACLE["coalesce_triggers"].replace("with recursive", "with recursive", 1)}),
w as (select max((epoch_us(ts) // 1000) // 100000) as mx from events)
select c.* from c, w where c.cancelled or c.fire_at < w.mx"""
