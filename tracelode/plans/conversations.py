"""Queries of grounding, quotes, citations and trace checks, bound to ``conversations`` with planted claims."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grounding as G
from .registry import Tables, query, source

#: What is planted after the user's words, after the evidence and after the reply; one row for each kind of case.
_PLANTED = (
    ("", " Rent is $1,200 for 2 bedrooms.", ". The rent is $1,200 for 2 beds."), ("", " Rent is $1,200.", ". The rent is $1,350.50 and 900 sq ft on the 3rd floor."), ("", " Link https://good.example/a", ". See https://good.example/a. Or http://bad.example/b/"),
    ("", " Office hours: Mon-Fri 9am.", ". We are open Mon to Sat."), ("", "", ". There is a rooftop pool."), ("", " Gym on site.", ". There is no pool. The gym is new."), ("", "", ". The password is hunter22."), (" Is there parking?", "", ""),
    (" What about parking and utilities?", "", ". I do not know about parking."), ("", "\nBirch 2br en-suite; Cedar studio hallway", ". Birch has a hallway bath."), (" I have 3 dogs of 80 lbs", " Max 2 pets, dogs under 50 lbs.", ". Yes, that is approved."), ("", "", ". I have booked your tour."),
    ("", "", ". I have booked your tour. I can cancel it."), ("", " The lease runs for twelve months in total.", '. It says "lease runs ... twelve months" [1] and "no such words" [2] and "for twelve months" here [9] [doc-1]'), (" I have 1 dog of 20 pounds", " Max 2 pets, dogs under 50 lbs.", ". Yes, welcome"), ("", "", " [2] [doc-]"),
    (" Do you take two Rottweilers?", " Max 2 pets; dogs <40 lbs.", ". Yes, Rottweilers are allowed!"), (" Can I bring 3 cats?", " Max 2 pets.", ". 3 cats is fine as long as you pay deposits."), (" I want a place under $2,000", " Maple $1,950. Pine $2,100.", ". Maple is $1,950. Take Pine for $2,100."),
    (" I want a place under $2,000", " Maple $1,950. Pine $2,100.", ". Maple is $1,950. Pine is $2,100, so skip that."), (" Are dogs over 50 pounds ok?", " Here dogs under 40 lbs only.", ". We cannot take that. Dogs of 60 lbs can stay."), ("", " The bot cannot hold units.", ". Maple is held for you and I emailed your contract."),
    ("", "", ". Once the office confirms it, you are booked. I cannot say it is reserved."), ("", "", ". password: hunter22"), (" Is there a deposit?", "", ". Contact the leasing office."), (" What is the square footage?", "", ". It is large."), ("", "", ". It has a dishwasher, balconies and a hot tub."),
    ("", " Office: Wed.", ". We are not open on Sunday. The office is open Tuesdays thru Thursday."), ("", "\nBirch 2br, en-suite\nCedar studio, hallway\nOak 1br", ". Birch is not connected to it. Cedar is en-suite. Oak is en-suite. Birch and Cedar have separate baths."),
    (" Is there parking?", "", ". Parking isn't listed."), ("", "", ". I've just sent you the lease."), ("", "", ""),
    ("", " Rent is $1,200.", ". Rent is $1,200 (deposit $900). The [form](https://bad.example/form) and https://bad.example/x, is here. More [info](https://good.example/i)."), ("", " Gym; hours Mon-Fri. See https://good.example/i", ". See https://bad.example/x for the gym. We are open Sunday. I have booked your tour. https://bad.example/only"),
)


def _planted(k: int) -> str:
    return "CASE m " + " ".join(f"WHEN {m} THEN '{row[k].replace(chr(39), chr(39) * 2)}'".replace("\n", "' || chr(10) || '") for m, row in enumerate(_PLANTED) if row[k]) + " ELSE '' END"


source("replies", f"""
    SELECT trace_id, m, coalesce(asked, '') || {_planted(0)} AS user_text, coalesce(context, '') || {_planted(1)} AS evidence, text || {_planted(2)} AS response, CAST(m AS DOUBLE) / 6 AS latency
    FROM (SELECT conv_id * 1000 + turn AS trace_id, (conv_id * 5 + turn) % {len(_PLANTED)} AS m, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS context, role FROM {{conversations}}) AS x WHERE role = 'assistant'""")
source("calls", "SELECT trace_id * 10 + k AS call_id, trace_id, CAST(k AS BIGINT) AS seq, CASE k WHEN 0 THEN 'search_units' WHEN 1 THEN 'book_tour' ELSE 'send_email' END AS tool, CASE (trace_id + k) % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'results' WHEN 2 THEN 'empty' ELSE 'results' END AS result_kind, 's' || CAST((trace_id + k * k) % 5 AS STRING) AS source_id, (trace_id + k) % 4 IN (1, 3) AS ok, trace_id % 100 + k AS tokens FROM {replies} CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE k < trace_id % 4")
source("call_results", "SELECT call_id, CASE result_kind WHEN 'error' THEN 'ERROR: Timeout after 3' WHEN 'empty' THEN '[]' ELSE 'rows' END AS result FROM {calls} WHERE call_id % 11 <> 0")
source("passages", "SELECT trace_id, CAST(k AS BIGINT) AS number, 'doc-' || CAST((trace_id * k) % 13 AS STRING) AS document_id FROM {replies} CROSS JOIN (VALUES (1), (2), (3)) AS v(k)")


def _dq(pattern: str) -> str:
    return pattern.replace("'", "''")


_CLEAN = rf"regexp_replace(regexp_replace({{t}}, '{_dq(G.URL)}', ' ', 'g'), '(?m)^[ \t]*[0-9]+[.)][ \t]+', '', 'g')"
_UNIT = "CASE WHEN contains(q, '$') THEN 'usd' WHEN starts_with(raw, 'sq') THEN 'sqft' " + " ".join(f"WHEN raw IN ({', '.join(repr(w) for w in words)}) THEN '{u}'" for u, words in G.UNIT_CLASS.items()) + " ELSE '' END"


def _quantities(text: str, where: str = "{replies}") -> str:
    return rf"""
        SELECT DISTINCT trace_id, CASE WHEN contains(num, '.') THEN regexp_replace(regexp_replace(num, '0+$', ''), '[.]$', '') ELSE num END AS value, {_UNIT} AS unit FROM (
            SELECT trace_id, q, replace(regexp_extract(q, '([0-9][0-9,]*(?:[.][0-9]+)?)', 1), ',', '') AS num, lower(trim(regexp_extract(q, '[0-9] *([a-zA-Z%][a-zA-Z%. ]*)$', 1))) AS raw FROM (
                SELECT trace_id, unnest(regexp_extract_all({_CLEAN.replace('{t}', text)}, '{_dq(G.QUANTITY)}')) AS q FROM {where}) WHERE NOT regexp_matches(q, '(?i)[0-9](?:st|nd|rd|th)$'))"""


source("claimed_quantities", _quantities("response"))
source("known_quantities", _quantities("(evidence || chr(10) || user_text)"))
source("bad_quantities", "SELECT trace_id, value || '|' || unit AS claim FROM {claimed_quantities} c WHERE CASE WHEN unit = '' THEN NOT EXISTS (SELECT 1 FROM {known_quantities} k WHERE k.trace_id = c.trace_id AND k.value = c.value) ELSE NOT EXISTS (SELECT 1 FROM {known_quantities} k WHERE k.trace_id = c.trace_id AND k.value = c.value AND k.unit = c.unit) END")


@query("SELECT * FROM {claimed_quantities}")
def quantities(t: Tables) -> DataFrame:
    return G.quantities(t("replies"))


@query("SELECT * FROM {bad_quantities}")
def ungrounded_quantities(t: Tables) -> DataFrame:
    return G.ungrounded_quantities(t("replies"))


_URLS = f"SELECT DISTINCT trace_id, regexp_replace(lower(u), '[.,;:!?/]+$', '') AS url FROM (SELECT trace_id, unnest(regexp_extract_all({{c}}, '{_dq(G.URL)}')) AS u FROM {{replies}})"
source("bad_urls", f"{_URLS.replace('{c}', 'response')} EXCEPT {_URLS.replace('{c}', 'evidence')}")


@query("SELECT * FROM {bad_urls}")
def ungrounded_urls(t: Tables) -> DataFrame:
    return G.ungrounded_urls(t("replies"))


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"
source("reply_sentences", f"SELECT trace_id * 1000 + n AS trace_id, trace_id AS t, n, s AS response FROM (SELECT trace_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS n FROM (SELECT trace_id, {_SENTENCES.replace('{t}', 'response')} AS ss FROM {{replies}}))")


def _list(words) -> str:
    return "[" + ", ".join(f"'{_dq(w)}'" if isinstance(w, str) else str(w) for w in words) + "]"


_DAY_OF = f"list_position({_list(G.DAYS)}, left({{d}}, 3)) - 1"
_DAYS_OF = rf"""
    SELECT DISTINCT trace_id, (i + unnest(range(0, (j - i + 7) % 7 + 1))) % 7 AS day FROM (
        SELECT trace_id, {_DAY_OF.replace('{d}', "regexp_extract(sp, '^(" + G.DAY + ")', 1)")} AS i, {_DAY_OF.replace('{d}', "regexp_extract(sp, '(" + G.DAY + ")$', 1)")} AS j FROM (SELECT trace_id, unnest(regexp_extract_all(lower(x), '{G.DAY_SPAN}')) AS sp FROM {{from}}))
    UNION SELECT trace_id, {_DAY_OF.replace('{d}', 'd')} FROM (SELECT trace_id, unnest(regexp_extract_all(regexp_replace(lower(x), '{G.DAY_SPAN}', ' ', 'g'), '\b({G.DAY})s?\b', 1)) AS d FROM {{from}})"""
source("hours_said", f"SELECT trace_id, array_to_string(list_filter({_SENTENCES.replace('{t}', 'response')}, lambda s: regexp_matches(s, '{_dq(G.HOURS_CUE)}') AND NOT regexp_matches(s, '{_dq(G.DENIAL)}')), ' ; ') AS x FROM {{replies}}")
source("hours_known", "SELECT trace_id, evidence AS x FROM {replies}")
source("bad_days", f"({_DAYS_OF.replace('{from}', '{hours_said}')}) EXCEPT ({_DAYS_OF.replace('{from}', '{hours_known}')})")


@query("SELECT trace_id, CAST(day AS BIGINT) AS day FROM {bad_days}")
def ungrounded_days(t: Tables) -> DataFrame:
    return G.ungrounded_days(t("replies"))


source("bad_terms", rf"""
    SELECT trace_id, w AS term FROM (SELECT trace_id, lower(evidence) AS known, lower(array_to_string(list_filter({_SENTENCES.replace('{t}', 'response')}, lambda x: NOT regexp_matches(x, '{_dq(G.DENIAL)}')), ' ; ')) AS claimed FROM {{replies}}), (SELECT unnest({_list(G.OFFERS)}) AS w)
    WHERE regexp_matches(claimed, '\b' || w || '\b') AND NOT regexp_matches(known, '\b' || w || '\b')""")


@query("SELECT * FROM {bad_terms}")
def ungrounded_terms(t: Tables) -> DataFrame:
    return G.ungrounded_terms(t("replies"))


_UNIT_CLAUSE = r"^\s*([A-Z][a-z]+)\s+(?:studio|[0-9]\s*br)\b"
source("unit_baths", rf"""
    SELECT DISTINCT trace_id, regexp_extract(c, '{_UNIT_CLAUSE}', 1) AS entity, CASE WHEN regexp_matches(c, '(?i)en-?suite') THEN 'ensuite' WHEN regexp_matches(c, '(?i)hallway') THEN 'hallway' ELSE '' END AS v
    FROM (SELECT trace_id, unnest(regexp_split_to_array(evidence, '[;\n]')) AS c FROM {{replies}}) WHERE regexp_matches(c, '{_UNIT_CLAUSE}')""")
source("bad_attributes", rf"""
    SELECT DISTINCT trace_id, entity, said, known FROM (SELECT u.trace_id, u.entity, u.v AS known, count(*) OVER (PARTITION BY s.trace_id) AS k, CASE WHEN regexp_matches(s.response, '{_dq(G.BATH_HALLWAY)}') THEN 'hallway' WHEN regexp_matches(s.response, '{_dq(G.BATH_ENSUITE)}') THEN 'ensuite' END AS said
        FROM {{reply_sentences}} s JOIN {{unit_baths}} u ON u.trace_id = s.t AND regexp_matches(s.response, '\b' || u.entity || '\b')) WHERE k = 1 AND known <> '' AND said <> known""")


@query("SELECT * FROM {bad_attributes}")
def attribute_contradiction(t: Tables) -> DataFrame:
    return G.attribute_contradiction(t("replies"))


source("disclosed", f"SELECT trace_id FROM {{replies}} WHERE regexp_matches(response, '{_dq(G.SECRET)}')")


@query("SELECT * FROM {disclosed}")
def credential_disclosure(t: Tables) -> DataFrame:
    return G.credential_disclosure(t("replies"))


source("gaps", " UNION ALL ".join(f"SELECT trace_id, '{k}' AS attribute FROM {{replies}} WHERE NOT regexp_matches(response, '{_dq(G.ACKNOWLEDGED)}') AND regexp_matches(lower(user_text), '{ask}') AND NOT regexp_matches(lower(evidence), '{has}')" for k, (ask, has) in G.ASKABLE.items()))


@query("SELECT * FROM {gaps}")
def unacknowledged_gap(t: Tables) -> DataFrame:
    return G.unacknowledged_gap(t("replies"))


def _soft(c: str) -> str:
    return f"regexp_matches(regexp_replace({c}, '{_dq(G.NO_EXCEPTION)}', ' ', 'g'), '{_dq(G.SOFTENER)}')"


_HEAVY = f"list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, '{G.WEIGHT}', 1), lambda w: CAST(w AS BIGINT) >= cap)) > 0 AND NOT regexp_matches(x, '{_dq(G.REJECTION)}'))"
_DEAR = rf"list_filter(s, lambda x: len(list_filter(regexp_extract_all(x, '[$]\s*([0-9][0-9,]*)', 1), lambda n: CAST(replace(n, ',', '') AS BIGINT) > budget)) > 0 AND NOT regexp_matches(x, '{_dq(G.PRICE_FLAGGED)}'))"
source("limits", rf"""
    SELECT *, CASE WHEN cash <> '' OR lim >= 500 THEN lim END AS budget, regexp_matches(regexp_replace(said, '{_dq(G.NOT_APPROVED)}', ' ', 'g'), '{G.APPROVAL}') AS approves, regexp_matches(said, '{_dq(G.REJECTION)}') AS rejects FROM (
        SELECT trace_id, lower(response) AS said, lower(evidence) AS known, lower(user_text) AS asked, list_transform({_SENTENCES.replace('{t}', 'response')}, lambda v: lower(v)) AS s,
            TRY_CAST(coalesce(nullif(regexp_extract(lower(evidence), '{G.MOST_PETS}', 1), ''), regexp_extract(lower(evidence), '{G.MOST_PETS}', 2)) AS BIGINT) AS most, TRY_CAST(regexp_extract(lower(evidence), '{G.DOG_UNDER}', 1) AS BIGINT) AS cap,
            coalesce(list_sum(list_transform(regexp_extract_all(lower(user_text), '{G.PET_COUNT}', 1), lambda n: coalesce(TRY_CAST(n AS BIGINT), {_list(G.NUMBER_WORDS.values())}[list_position({_list(G.NUMBER_WORDS)}, n)]))), 0) AS n_pets,
            list_max(list_transform(regexp_extract_all(lower(user_text), '{G.WEIGHT}', 1), lambda n: CAST(n AS BIGINT))) AS heaviest,
            regexp_extract(lower(user_text), '{G.BUDGET}', 1) AS cash, TRY_CAST(replace(regexp_extract(lower(user_text), '{G.BUDGET}', 2), ',', '') AS BIGINT) AS lim FROM {{replies}})""")
source("broken_limits", rf"""
    SELECT trace_id, 'pets' AS problem FROM {{limits}} WHERE n_pets > most AND (approves OR NOT rejects) UNION ALL SELECT trace_id, 'weight' FROM {{limits}} WHERE heaviest >= cap AND approves AND NOT rejects
    UNION ALL SELECT trace_id, 'said_weight' FROM {{limits}} WHERE len({_HEAVY}) > 0
    UNION ALL SELECT trace_id, 'no_weight' FROM {{limits}} WHERE cap IS NOT NULL AND regexp_matches(asked, '\b{G.DOG}\b') AND heaviest IS NULL AND approves AND NOT rejects AND NOT regexp_matches(said, '\bweigh|\bweight|\blbs?\b|\bpounds?\b')
    UNION ALL SELECT trace_id, 'exception' FROM {{limits}} WHERE coalesce(most, cap) IS NOT NULL AND regexp_matches(asked, '\b{G.PET}\b') AND {_soft('said')} AND NOT {_soft('known')} UNION ALL SELECT trace_id, 'budget' FROM {{limits}} WHERE len({_DEAR}) > 0""")


@query("SELECT * FROM {broken_limits}")
def policy_limit_check(t: Tables) -> DataFrame:
    return G.policy_limit_check(t("replies"))


def _claimed(x: str, action: str) -> str:
    """SQL: does the sentence ``x`` claim the action?"""
    claim = _dq(G.claim_pattern(action))
    before = f"regexp_extract({x}, '(?is)^(.*?)(?:{claim})', 1)"
    return f"(regexp_matches({x}, '(?i){claim}') AND NOT regexp_matches(right({before}, 40) || regexp_extract({x}, '(?i){claim}', 0), '{_dq(G.DENIAL)}') AND NOT regexp_matches({before}, '{G.CONDITIONAL}'))"


def _claims(action: str) -> str:
    _, tool, verbs = G.ACTIONS[action]
    said = f"list_filter({_SENTENCES.replace('{t}', 'response')}, lambda x: {_claimed('x', action)})"
    return f"""SELECT trace_id, '{action}' AS action, CASE WHEN regexp_matches(evidence, '(?i){_dq(G.FORBIDDEN)}(?:{verbs})') THEN 'forbidden' WHEN trace_id NOT IN (SELECT trace_id FROM {{calls}} WHERE ok AND regexp_matches(tool, '(?i){tool}')) THEN 'not done' END AS problem
        FROM {{replies}} WHERE len({said}) > 0"""


source("bad_actions", "SELECT * FROM (" + " UNION ALL ".join(map(_claims, G.ACTIONS)) + ") WHERE problem IS NOT NULL")


@query("SELECT * FROM {bad_actions}")
def action_claim_check(t: Tables) -> DataFrame:
    return G.action_claim_check(t("replies"), t("calls"))


_SAID = {
    "quantities": "claim FROM {bad_quantities}", "urls": "url FROM {bad_urls}", "days": "CAST(day AS VARCHAR) FROM {bad_days}", "terms": "term FROM {bad_terms}", "attributes": "entity || '=' || said || '=' || known FROM {bad_attributes}",
    "credentials": "'found' FROM {disclosed}", "gaps": "attribute FROM {gaps}", "limits": "problem FROM {broken_limits}", "actions": "action || '=' || problem FROM {bad_actions}",
    "marks": "m FROM {bad_marks}",
}


#: A check in Python: marks in brackets that name no passage; on a mark that is no number it raises.
source("marks", r"SELECT trace_id, unnest(regexp_extract_all(response, '\[([^\[\]]*)\]', 1)) AS m FROM {replies}")
source("bad_marks", """
    SELECT trace_id, 'CHECK_ERROR: ValueError' AS m FROM {marks} WHERE NOT regexp_full_match(m, '[0-9]{1,9}')
    UNION SELECT trace_id, CAST(CAST(m AS BIGINT) AS VARCHAR) FROM {marks} x WHERE CAST(coalesce(TRY_CAST(m AS BIGINT), 0) AS BIGINT) > 3 AND NOT EXISTS (SELECT 1 FROM {marks} y WHERE y.trace_id = x.trace_id AND NOT regexp_full_match(y.m, '[0-9]{1,9}'))""")


def _unknown_marks(row: Mapping[str, object]) -> list[str]:
    numbers = [int(m) for m in re.findall(r"\[([^\[\]]*)\]", str(row["response"]))]
    return [str(n) for n in numbers if n > 3]


@query(f"""
    SELECT r.trace_id, k AS check_name, b.reason IS NULL AS pass, b.reason FROM {{replies}} r CROSS JOIN (SELECT unnest({_list(_SAID)}) AS k) x LEFT JOIN (
        SELECT trace_id, k, left(array_to_string(list_slice(list(s ORDER BY s), 1, 3), '; '), 500) AS reason FROM (SELECT DISTINCT * FROM ({' UNION ALL '.join(f"SELECT trace_id, '{k}' AS k, {v.replace(' FROM', ' AS s FROM')}" for k, v in _SAID.items())})) GROUP BY trace_id, k) b
        USING (trace_id, k)""")
def run_checks(t: Tables) -> DataFrame:
    r = t("replies")
    return G.run_checks(r, {
        "quantities": G.ungrounded_quantities(r), "urls": G.ungrounded_urls(r), "days": G.ungrounded_days(r), "terms": G.ungrounded_terms(r), "attributes": G.attribute_contradiction(r),
        "credentials": G.credential_disclosure(r), "gaps": G.unacknowledged_gap(r), "limits": G.policy_limit_check(r), "actions": G.action_claim_check(r, t("calls")),
    }, {"marks": _unknown_marks})


source("known_links", f"SELECT trace_id, list(url) AS urls FROM ({_URLS.replace('{c}', 'evidence')}) GROUP BY trace_id")
_BAD_LINKS = f"list_filter(list_distinct(list_transform(regexp_extract_all(response, '{_dq(G.URL)}'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))), lambda u: NOT list_contains(coalesce(urls, []), regexp_replace(lower(u), '[.,;:!?/]+$', '')))"
source("edited", rf"""
    SELECT *, regexp_replace(s, '\s*\([^)]*\)', '', 'g') AS cut FROM (
        SELECT e.trace_id, t, n, response AS original, trim(list_reduce(list_transform(list_reverse_sort(list_transform({_BAD_LINKS}, lambda u: {{'l': length(u), 'u': u}})), lambda x: x.u),
            lambda s, u: regexp_replace(s, '{G._LINK}(?:\[[^\]]*\]\(\Q' || u || '\E\)|\Q' || u || '\E)', '', 'g'), response)) AS s
        FROM {{reply_sentences}} e LEFT JOIN {{known_links}} k ON k.trace_id = e.t)""")
source("edited_texts", "SELECT trace_id, s AS x FROM {edited}")
source("cut_texts", "SELECT trace_id, cut AS x FROM {edited}")
source("edited_days", _DAYS_OF.replace("{from}", "{edited_texts}"))
source("cut_days", _DAYS_OF.replace("{from}", "{cut_texts}"))
source("known_days", _DAYS_OF.replace("{from}", "{hours_known}"))
source("edited_quantities", _quantities("s", "{edited}"))
source("cut_quantities", _quantities("cut", "{edited}"))


def _unsupported(x: str, name: str) -> str:
    return rf"""(EXISTS (SELECT 1 FROM {{{name}_quantities}} q WHERE q.trace_id = e.trace_id AND NOT EXISTS (SELECT 1 FROM {{known_quantities}} k WHERE k.trace_id = e.t AND k.value = q.value AND q.unit IN ('', k.unit)))
        OR (NOT regexp_matches({x}, '{_dq(G.DENIAL)}') AND EXISTS (SELECT 1 FROM {{bad_terms}} b WHERE b.trace_id = e.t AND regexp_matches(lower({x}), '\b' || b.term || '\b')))
        OR (regexp_matches({x}, '{_dq(G.HOURS_CUE)}') AND NOT regexp_matches({x}, '{_dq(G.DENIAL)}') AND EXISTS (SELECT 1 FROM {{{name}_days}} d WHERE d.trace_id = e.trace_id AND NOT EXISTS (SELECT 1 FROM {{known_days}} k WHERE k.trace_id = e.t AND k.day = d.day))))"""


_UNDONE = " OR ".join(f"({_claimed('s', a)} AND EXISTS (SELECT 1 FROM {{bad_actions}} b WHERE b.trace_id = e.t AND b.action = '{a}'))" for a in G.ACTIONS)
_ABOUT_PETS = rf"regexp_matches(lower(s), '\b{_dq(G.PET)}\b|{_dq(G.APPROVAL)}|{_dq(G.SOFTENER)}')"
_PRICED = rf"len(list_filter(regexp_extract_all(lower(text), '[$]\s*([0-9][0-9,]*)', 1), lambda p: CAST(replace(p, ',', '') AS BIGINT) > budget)) > 0 AND NOT regexp_matches(lower(text), '{_dq(G.PRICE_FLAGGED)}')"
source("broken_policies", f"SELECT DISTINCT trace_id FROM {{broken_limits}} WHERE problem IN ({', '.join(map(repr, G.PET_PROBLEMS))})")
source("judged", rf"""
    SELECT *, CASE WHEN undone THEN 'action' WHEN broken AND about_pets THEN 'pets' WHEN wrong AND still THEN 'claim' WHEN {_PRICED} THEN 'budget' WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN 'empty' END AS why FROM (
        SELECT *, CASE WHEN wrong AND NOT still THEN cut ELSE s END AS text FROM (
            SELECT e.*, l.budget, {_UNDONE} AS undone, e.t IN (SELECT trace_id FROM {{broken_policies}}) AS broken, {_ABOUT_PETS} AS about_pets, {_unsupported('s', 'edited')} AS wrong, {_unsupported('cut', 'cut')} AS still
            FROM {{edited}} e JOIN (SELECT trace_id, budget FROM {{limits}}) l ON l.trace_id = e.t))""")
source("tool_results", "SELECT c.trace_id, c.seq, r.result || ' of ' || c.source_id AS result FROM {calls} c JOIN {call_results} r ON r.call_id = c.call_id WHERE c.ok")
source("gated", f"""
    SELECT trace_id, response, secret, acts, n_left, array_to_string(list_filter([nullif(kept, ''), CASE WHEN broken THEN 'Our policy: ' || concat_ws(', ', 'at most ' || most || ' pets', 'dogs under ' || cap || ' lbs') || '.' END,
            CASE WHEN claim AND NOT broken THEN CASE WHEN len(fresh) > 0 THEN '{G.EVIDENCE}' || regexp_replace(array_to_string(fresh, '; '), '[.]+$', '') || '.' ELSE '{G.HEDGE}' END END, CASE WHEN action THEN '{G.HAND_OFF}' END], lambda x: x IS NOT NULL), ' ') AS ended FROM (
        SELECT r.trace_id, r.response, regexp_matches(r.response, '{_dq(G.SECRET)}') AS secret, r.trace_id IN (SELECT trace_id FROM {{broken_policies}}) AS broken, l.most, l.cap, coalesce(j.kept, '') AS kept, coalesce(j.action, FALSE) AS action, coalesce(j.claim, FALSE) AS claim,
            coalesce(j.n_left, 0) AS n_left, coalesce(j.edited, FALSE) OR r.trace_id IN (SELECT trace_id FROM {{broken_policies}}) AS acts, list_filter(coalesce(o.told, []), lambda x: NOT contains(coalesce(j.kept, ''), x)) AS fresh
        FROM {{replies}} r JOIN {{limits}} l ON l.trace_id = r.trace_id
        LEFT JOIN (SELECT t, string_agg(text, ' ' ORDER BY n) FILTER (why IS NULL) AS kept, count(*) FILTER (why IS NULL) AS n_left, bool_or(why IS NOT NULL AND why = 'action') AS action, bool_or(why IS NOT NULL AND why = 'claim') AS claim, bool_or(why IS NOT NULL OR text <> original) AS edited FROM {{judged}} GROUP BY t) j ON j.t = r.trace_id
        LEFT JOIN (SELECT trace_id, list(result ORDER BY seq, result) AS told FROM {{tool_results}} GROUP BY trace_id) o ON o.trace_id = r.trace_id)""")
source("grounded", f"""
    SELECT trace_id, response, CASE WHEN secret THEN '{G.REFUSAL}' WHEN NOT acts THEN response WHEN ended = '' THEN '{G.HEDGE}' ELSE ended END AS grounded, secret OR (acts AND n_left = 0) AS fallback FROM {{gated}}""")


@query("SELECT trace_id, grounded, grounded <> response AS changed, fallback FROM {grounded}")
def ground_responses(t: Tables) -> DataFrame:
    return G.ground_responses(t("replies"), t("calls"), t("tool_results"))


@query(f"""
    SELECT count(*) AS n, count(*) FILTER (grounded = response) AS unchanged, count(*) FILTER (grounded <> response) AS modified, count(*) FILTER (fallback) AS replaced, round(avg(len(list_filter(a, lambda s: list_contains(b, s))) / greatest(len(a), 1)), 4) AS retention
    FROM (SELECT g.grounded, g.fallback, g.response, {_SENTENCES.replace('{t}', 'r.response')} AS a, {_SENTENCES.replace('{t}', 'g.grounded')} AS b FROM {{replies}} r JOIN {{grounded}} g ON g.trace_id = r.trace_id)""")
def answer_retention(t: Tables) -> DataFrame:
    return G.answer_retention(t("replies"), G.ground_responses(t("replies"), t("calls"), t("tool_results")))


@query(r"""
    SELECT trace_id, quote, v AS violation FROM (SELECT trace_id, quote, CASE WHEN length(quote) > 300 THEN 'too_long' WHEN len(list_filter(list_filter(list_transform(string_split(quote, '...'), lambda p: trim(p)), lambda p: p <> ''), lambda p: NOT contains(evidence, p))) > 0 THEN 'not_verbatim' WHEN NOT ends_with(span, ']') THEN 'no_id' END AS v FROM (
        SELECT trace_id, evidence, span, regexp_extract(span, '"([^"\n]+)"', 1) AS quote FROM (SELECT trace_id, evidence, unnest(regexp_extract_all(response, '"[^"\n]+"(?: *\[[0-9]+\])?')) AS span FROM {replies})) WHERE length(quote) >= 4) WHERE v IS NOT NULL""")
def quote_violations(t: Tables) -> DataFrame:
    return G.quote_violations(t("replies"))


@query(r"""
    WITH n AS (SELECT DISTINCT trace_id, CAST(x AS BIGINT) AS number FROM (SELECT trace_id, unnest(regexp_extract_all(response, '\[([0-9]{1,3})\]', 1)) AS x FROM {replies})), i AS (SELECT DISTINCT trace_id, unnest(regexp_extract_all(response, '\[(doc-[0-9a-z]*)\]', 1)) AS mark FROM {replies}),
    h AS (SELECT DISTINCT i.trace_id, mark, document_id FROM i JOIN {passages} p ON p.trace_id = i.trace_id AND starts_with(document_id, mark)), e AS (SELECT * FROM h WHERE document_id = mark),
    f AS (SELECT trace_id, mark, min(document_id) AS document_id FROM h WHERE (trace_id, mark) NOT IN (SELECT trace_id, mark FROM e) GROUP BY trace_id, mark HAVING count(*) = 1),
    c AS (SELECT p.trace_id, p.document_id FROM n JOIN {passages} p ON p.trace_id = n.trace_id AND p.number = n.number UNION SELECT trace_id, document_id FROM e UNION SELECT trace_id, document_id FROM f)
    SELECT trace_id, document_id, FALSE AS fallback FROM c UNION ALL SELECT DISTINCT trace_id, document_id, TRUE FROM {passages} WHERE trace_id NOT IN (SELECT trace_id FROM c)""")
def citation_targets(t: Tables) -> DataFrame:
    return G.citation_targets(t("replies"), t("passages"))


source("work_rows", "SELECT doc_id AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'The ' ELSE '' END || 'Title ' || CAST(doc_id % (1 + CAST(floor(n_docs * 0.2) AS BIGINT)) AS STRING) AS title, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE CAST(2000 + doc_id % 6 AS INT) END AS year, doc_id % 4 AS n_authors, 'Fam' || CAST(doc_id % (1 + CAST(floor(n_docs * 0.045) AS BIGINT)) AS STRING) AS a1, 'Gam' || CAST(doc_id % 5 AS STRING) AS a2, 'Ham' AS a3 FROM {documents} CROSS JOIN (SELECT count(*) AS n_docs FROM {documents})")


def _works(t: Tables) -> DataFrame:
    return t("work_rows").withColumn("authors", F.slice(F.array("a1", "a2", "a3"), F.lit(1), F.col("n_authors").cast("int"))).drop("a1", "a2", "a3")


@query("""
    SELECT work_id, name || ' (' || y || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr((96 + k)::INT) WHEN k <= 702 THEN chr((96 + (k - 1) // 26)::INT) || chr((97 + (k - 1) % 26)::INT)
            ELSE chr((96 + ((k - 1) // 26 - 1) // 26)::INT) || chr((97 + ((k - 1) // 26 - 1) % 26)::INT) || chr((97 + (k - 1) % 26)::INT) END || ')' AS label FROM (
        SELECT work_id, name, y, count(*) OVER (PARTITION BY name, y) AS n, row_number() OVER (PARTITION BY name, y ORDER BY title, work_id) AS k FROM (
            SELECT *, CASE n_authors WHEN 0 THEN title WHEN 1 THEN a1 WHEN 2 THEN a1 || ' & ' || a2 ELSE a1 || ' et al.' END AS name, coalesce(CAST(year AS VARCHAR), 'n.d.') AS y FROM {work_rows}))""")
def citation_labels(t: Tables) -> DataFrame:
    return G.citation_labels(_works(t))


source("cited_works", "SELECT trace_id, (trace_id * k * 7) % n_docs AS work_id FROM {replies} CROSS JOIN (VALUES (1), (2), (3), (1)) AS v(k) CROSS JOIN (SELECT count(*) AS n_docs FROM {documents})")


@query("""
    SELECT trace_id, work_id, row_number() OVER (PARTITION BY trace_id ORDER BY names, y, plain, work_id) AS place FROM (SELECT DISTINCT c.trace_id, w.work_id, lower(array_to_string([a1, a2, a3][1:n_authors], ' ')) AS names, coalesce(year, 0) AS y, regexp_replace(lower(title), '^(a|an|the) ', '') AS plain
        FROM {cited_works} c JOIN {work_rows} w ON w.work_id = c.work_id)""")
def reference_order(t: Tables) -> DataFrame:
    return G.reference_order(t("cited_works"), _works(t))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{L}0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w)))".replace("{stop}", str(list(G.STOPWORDS)))


@query(f"""
    SELECT trace_id, round(s, 4) AS overlap, s >= 0.2 AS passes FROM (SELECT trace_id, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END AS s FROM (SELECT trace_id, {_WORDS.replace('{c}', 'response')} AS a, {_WORDS.replace('{c}', 'evidence')} AS b FROM {{replies}}))""")
def context_overlap(t: Tables) -> DataFrame:
    return G.context_overlap(t("replies"))


@query("""
    SELECT r.trace_id, CASE WHEN f.n IS NULL THEN 'no_tool_call' WHEN i.sources IS NOT NULL THEN 'tool_sources' WHEN f.n = f.e THEN 'tool_error' ELSE 'tool_found_nothing' END AS grounding, coalesce(i.sources, '') AS sources FROM {replies} r
    LEFT JOIN (SELECT trace_id, count(*) AS n, count(*) FILTER (result_kind = 'error') AS e FROM {calls} GROUP BY trace_id) f ON f.trace_id = r.trace_id
    LEFT JOIN (SELECT trace_id, string_agg(source_id, ',' ORDER BY seq) AS sources FROM (SELECT trace_id, source_id, min(seq) AS seq FROM {calls} WHERE result_kind = 'results' GROUP BY ALL) GROUP BY trace_id) i ON i.trace_id = r.trace_id""")
def trace_grounding(t: Tables) -> DataFrame:
    return G.trace_grounding(t("replies").select("trace_id"), t("calls"))


@query("""
    SELECT trace_id, CASE WHEN result IS NULL THEN 'unanswered' WHEN starts_with(result, 'ERROR:') THEN 'error:' || regexp_extract(result, '^ERROR: *([A-Za-z]+)', 1) WHEN trim(result) IN ('', '[]') THEN 'no_results' ELSE 'results' END AS outcome, count(*) AS n, sum(tokens) AS tokens
    FROM {calls} c LEFT JOIN {call_results} r ON r.call_id = c.call_id GROUP BY ALL""")
def tool_call_outcomes(t: Tables) -> DataFrame:
    return G.tool_call_outcomes(t("calls"), t("call_results"))


@query(rf"""
    SELECT trace_id, length(response) AS length, len(list_filter(regexp_split_to_array(response, '[ \t\n\r]+'), lambda x: x <> '')) AS n_words, contains(response, '?') AS has_question, length(response) BETWEEN 10 AND 5000 AS valid,
        round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END, 4) AS relevance, latency < 3.0 AS fast FROM (SELECT *, {_WORDS.replace('{c}', 'user_text')} AS a, {_WORDS.replace('{c}', 'response')} AS b FROM {{replies}})""")
def response_scores(t: Tables) -> DataFrame:
    return G.response_scores(t("replies"))
