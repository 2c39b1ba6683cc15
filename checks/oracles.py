"""SQL counterparts of the registered queries, for an engine with RE2 regular expressions.

Each is written from the definition of the result, not from the Spark plan.
"""

from __future__ import annotations

import math

from lurescope.functions.url_basic import FEATURES as BASIC
from lurescope.functions.url_enriched import BRANDS, FEATURES, KEYWORDS, SHORTENERS

WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

EMAILS = r"""
link as (
  select page_id*4 as doc_id, page_id, url from pages
  union all
  select (page_id - page_id % 2)*4 + 1 as doc_id, page_id, url from pages),
ranked as (select doc_id, page_id, url, row_number() over (partition by doc_id order by page_id) rn from link),
wide as (select doc_id, max(case when rn=1 then url end) u1, max(case when rn=2 then url end) u2 from ranked group by doc_id),
emails as (select d.doc_id as email_id,
 concat(d.text, case when u1 is null then '' else concat(' see ',u1) end,
        case when u2 is null then '' else concat(' or <',u2,'>') end,
        case when d.doc_id % 11 = 0 then ' SSN 123-45-6789 C:\new' else '' end) as body,
 cast(l.toxic as integer) as label
from documents d left join wide w on w.doc_id=d.doc_id left join labels l on l.doc_id=d.doc_id)"""

SRC_A = "select url, cast(page_id % 2 as integer) as label, 'a' as source from pages where page_id % 23 <> 0 and page_id % 29 <> 0"
SRC_B = "select url, cast(page_id % 2 as integer) as label, 'b' as source from pages where page_id % 17 <> 0"
SRC_C = ("select url, cast(case when page_id % 15 = 0 then 1 - page_id % 2 else page_id % 2 end as integer) as label, "
         "'c' as source from pages where page_id % 19 <> 0")
UNION = f"unioned as ({SRC_A} union all {SRC_B} union all {SRC_C})"
CORPUS = UNION + """,
agreed as (select url, min(label) as label, min(source) as source from unioned group by url having min(label) = max(label))"""


def split_cte(source: str, key: str, stratum: str, name: str) -> str:
    return f"""
{name}_r as (select *, row_number() over (partition by {stratum} order by md5(concat(cast({key} as varchar), '|42'))) as _rk,
   count(*) over (partition by {stratum}) as _n from {source}),
{name} as (select * exclude (_rk, _n), case when _rk <= (_n * 8) // 10 then 'train'
   when _rk <= (_n * 8) // 10 + (_n - (_n * 8) // 10) // 2 then 'val' else 'test' end as split from {name}_r)"""


SPLIT = CORPUS + "," + split_cte("agreed", "url", "label", "splitted")


def entropy(s: str) -> str:
    return (f"(case when length({s}) = 0 then 0.0 else list_sum(list_transform(list_distinct(string_split({s}, '')), "
            f"lambda c: -((length({s}) - length(replace({s}, c, ''))) / length({s})::double) * "
            f"log2((length({s}) - length(replace({s}, c, ''))) / length({s})::double))) end)")


def longest(s: str, pattern: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({s}, '{pattern}'), lambda x: length(x))), 0)"


def count_of(s: str, what: str) -> str:
    return f"((length({s}) - length(replace({s}, '{what}', ''))) / {len(what)})"


def regex_count(s: str, pattern: str) -> str:
    return f"len(regexp_extract_all({s}, '{pattern}'))"


def enriched_cte(source: str, name: str) -> str:
    """CTEs that add the enriched features to every column of ``source`` (which has ``url``)."""
    exprs = {
        "url_entropy": entropy("u"),
        "domain_entropy": entropy("dom"),
        "vowel_ratio": regex_count("u", "[aeiouAEIOU]") + r" / greatest(" + regex_count("u", r"\p{L}") + ", 1)",
        "consonant_run_max": longest("dom", "[b-df-hj-np-tv-z]+"),
        "digit_run_max": longest("u", "[0-9]+"),
        "char_class_transitions": "turns",
        "char_class_transition_ratio": "turns / greatest(length(dom), 1)",
        "suspicious_keyword_count": " + ".join(count_of("lower(u)", k) for k in KEYWORDS),
        "has_suspicious_keyword": "(" + " or ".join(f"contains(lower(u), '{k}')" for k in KEYWORDS) + ")::integer",
        "brand_in_path_not_domain": "(" + " or ".join(
            f"(contains(lower(path), '{b}') and not contains(dom, '{b}'))" for b in BRANDS) + ")::integer",
        "hyphen_count_domain": count_of("dom", "-"),
        "digit_ratio_domain": regex_count("dom", "[0-9]") + " / greatest(length(dom), 1)",
        "subdomain_depth": f"greatest({count_of('dom', '.')} - 1, 0)",
        "path_depth": count_of("path", "/"),
        "is_ip_host": r"regexp_matches(bare, '^\d{1,3}(\.\d{1,3}){3}$')::integer",
        "has_port": "(contains(host, ':') and not starts_with(host, 'http'))::integer",
        "has_at_symbol": "contains(u, '@')::integer",
        "percent_encoding_count": count_of("u", "%"),
        "percent_encoding_ratio": count_of("u", "%") + " / greatest(length(u), 1)",
        "is_shortener": "(dom in (" + ", ".join(f"'{h}'" for h in SHORTENERS) + "))::integer",
        "has_punycode": "contains(bare, 'xn--')::integer",
        "domain_to_url_len_ratio": "length(dom) / greatest(length(u), 1)",
        "num_dots": count_of("u", "."),
        "has_https": "(scheme = 'https')::integer",
    }
    columns = ", ".join(f"({exprs[f]})::double as {f}" for f in FEATURES)
    return rf"""
{name}_0 as (select *, coalesce(url, '') as u from {source}),
{name}_1 as (select *, case when contains(u, '://') then u else concat('http://', u) end as absu from {name}_0),
{name}_2 as (select *, lower(regexp_extract(absu, '^([a-zA-Z][a-zA-Z0-9+.\-]*):', 1)) as scheme,
   regexp_replace(absu, '^[a-zA-Z][a-zA-Z0-9+.\-]*:', '') as rest from {name}_1),
{name}_3 as (select *, lower(regexp_extract(rest, '^//([^/?#]*)', 1)) as host,
   regexp_replace(regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '') as path from {name}_2),
{name}_4 as (select *, string_split(host, ':')[1] as bare from {name}_3),
{name}_5 as (select *, regexp_replace(bare, '^www\.', '') as dom from {name}_4),
{name}_6 as (select *, greatest({regex_count('dom', '[a-z]+|[0-9]+|[^a-z0-9]+')} - 1, 0) as turns from {name}_5),
{name} as (select * exclude (u, absu, scheme, rest, host, path, bare, dom, turns), {columns} from {name}_6)"""


def basic_cte(source: str, name: str) -> str:
    share = lambda e: f"(case when n > 0 then ({e}) / n else 0.0 end)"
    letters, digits = regex_count("body", r"\p{L}"), regex_count("body", "[0-9]")
    special = regex_count("body", r"[^\p{L}\p{N}]")
    obf = f"({regex_count('body', '%[0-9a-fA-F]{2}')} + {regex_count('body', '[^[:ascii:]]')})"
    eq, qm, amp = (count_of("body", c) for c in "=?&")
    exprs = {
        "URLLength": "n", "DomainLength": "length(host)",
        "IsDomainIP": r"regexp_matches(host, '^\d{1,3}(\.\d{1,3}){3}$')::integer",
        "TLDLength": "length(list_last(string_split(host, '.')))",
        "NoOfSubDomain": "greatest(len(string_split(host, '.')) - 2, 0)",
        "HasObfuscation": f"({obf} > 0)::integer", "NoOfObfuscatedChar": obf, "ObfuscationRatio": share(obf),
        "NoOfLettersInURL": letters, "LetterRatioInURL": share(letters),
        "NoOfDegitsInURL": digits, "DegitRatioInURL": share(digits),
        "NoOfEqualsInURL": eq, "NoOfQMarkInURL": qm, "NoOfAmpersandInURL": amp,
        "NoOfOtherSpecialCharsInURL": f"{special} - {eq} - {qm} - {amp}",
        "SpacialCharRatioInURL": share(special), "IsHTTPS": "starts_with(lower(absu), 'https:')::integer",
    }
    columns = ", ".join(f'({exprs[f]})::double as "{f}"' for f in BASIC)
    return rf"""
{name}_0 as (select *, coalesce(url, '') as u from {source}),
{name}_1 as (select *, case when regexp_matches(trim(u), '^[a-zA-Z][a-zA-Z0-9+.\-]*://') then trim(u) else concat('http://', trim(u)) end as absu,
   substring(u, 1, greatest(length(u) - 1, 0)) as cut from {name}_0),
{name}_2 as (select *, string_split(list_last(string_split(regexp_extract(absu, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '@')), ':')[1] as host,
   length(cut) as n, regexp_replace(regexp_replace(cut, '^[a-zA-Z][a-zA-Z0-9+.\-]*://', ''), '(?i)^www\.', '') as body from {name}_1),
{name} as (select * exclude (u, absu, cut, host, n, body), {columns} from {name}_2)"""


def rounded(columns, prefix: str = "") -> str:
    return ", ".join(f'round({prefix}"{c}", 6) + 0.0 as "{c}"' for c in columns)


def stats_cte(source: str, columns, name: str) -> str:
    cells = ", ".join(
        f'avg("{c}") as "m_{c}", case when stddev_pop("{c}") = 0 then 1.0 else stddev_pop("{c}") end as "s_{c}"'
        for c in columns
    )
    return f"{name} as (select {cells} from {source})"


def scaled(columns) -> list[str]:
    return [f'("{c}" - "m_{c}") / "s_{c}"' for c in columns]


def clean(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '\\[ntr]', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


# The redaction patterns in order.
REDACT_STEPS = (
    ("<SSN>", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("<CARD>", r"\b(?:\d[ -]*?){13,16}\b"),
    ("<PHONE>", rf"(?:\+?\d{{1,3}}[{WS}.-]?)?(?:\(?\d{{3}}\)?[{WS}.-]?)\d{{3}}[{WS}.-]?\d{{4}}"),
    ("<EMAIL>", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("<URL>", rf"https?://[^{WS}]+|www\.[^{WS}]+"),
)


def redact(text: str) -> str:
    for token, pattern in REDACT_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{token}', 'g')"
    return text


def redact_ctes(source: str, text: str, key: str) -> str:
    """One CTE per step, so that each step's matches can be counted on its own input."""
    parts, previous = [], f"(select {key}, {text} as t from {source})"
    for i, (token, pattern) in enumerate(REDACT_STEPS):
        name = token[1:-1].lower()
        kept = "".join(f", n_{t[1:-1].lower()}" for t, _ in REDACT_STEPS[:i])
        parts.append(
            f"step{i} as (select {key}, regexp_replace(t, '{pattern}', '{token}', 'g') as t{kept}, "
            f"len(regexp_extract_all(t, '{pattern}')) as n_{name} from {previous} q)"
        )
        previous = f"step{i}"
    return ",\n".join(parts)


URLS = rf"""found as (select email_id, label, regexp_extract_all(body, 'https?://[^{WS}<>"'']+|www\.[^{WS}<>"'']+') as us from emails),
urls as (select email_id, label, i - 1 as url_index, us[i] as url from (select *, unnest(range(1, len(us) + 1)) as i from found))"""

MESSAGES = EMAILS + """,
messages as (select email_id as row_id, case when email_id % 97 <> 0 then body end as text,
  case label when 0 then 0 when 1 then 1 end as label from emails)"""

SCORES = """scores as (select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as key,
  l_extendedprice / 1e5 as score, l_quantity / 50 as score2, (l_returnflag = 'R')::integer as y,
  case when l_orderkey % 2 = 0 then 'val' else 'test' end as split from lineitem)"""


def areas(source: str, score: str, by: str = "", y: str = "y") -> str:
    """Subquery with auc_roc and auc_pr per group, from sorted distinct scores."""
    group = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    tail = f"group by {by}" if by else ""
    return f"""(with g as (select {group}{score} as s, sum({y}) as p, sum(1 - {y}) as n from {source}
   where {y} is not null and {score} is not null group by {group}{score}),
 c as (select *, sum(p) over ({part}order by s desc) as tp, sum(n) over ({part}order by s desc) as fp from g)
 select {group}sum((tp - p / 2.0) * n) / nullif(sum(p)::double * sum(n), 0) as auc_roc,
   sum(p * (tp / (tp + fp)::double)) / sum(p) as auc_pr from c {tail})"""


CONFUSION = """count(*) filter (not hit and y = 0) as tn, count(*) filter (hit and y = 0) as fp,
 count(*) filter (not hit and y = 1) as fn, count(*) filter (hit and y = 1) as tp"""
RATES = {
    "precision": "case when tp + fp = 0 then 0.0 else tp / (tp + fp)::double end",
    "recall": "case when tp + fn = 0 then 0.0 else tp / (tp + fn)::double end",
    "f1": "case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn)::double end",
    "false_positive_rate": "case when fp + tn = 0 then 0.0 else fp / (fp + tn)::double end",
    "accuracy": "(tp + tn) / (tp + tn + fp + fn)::double",
}


def rates(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({RATES[n]}, {digits}) as {n}" for n in names)


THRESHOLDS = f"""
vals as (select score as s, y from scores where split = 'val'),
probs as (select i, i / 100.0::double as p from range(1, 100) r(i)),
grid as (select list(s order by s) as ss, count(*) as cnt from vals),
cand as (select i, ss[h + 1] + (ss[least(h + 2, cnt)] - ss[h + 1]) * (pos - h) as t
  from (select i, ss, cnt, (cnt - 1) * p as pos, floor((cnt - 1) * p)::bigint as h from probs, grid)),
cells as (select i, t, count(*) filter (s >= t and y = 1) as tp, count(*) filter (s >= t and y = 0) as fp,
  count(*) filter (s < t and y = 1) as fn, count(*) filter (s < t and y = 0) as tn from cand, vals group by i, t),
rated as (select *, {RATES['recall']} as tpr, {RATES['false_positive_rate']} as fpr, {RATES['f1']} as f1 from cells),
best_f1 as (select 'f1' as strategy, t as threshold, f1 as strategy_value from rated order by f1 desc, i limit 1),
best_youden as (select 'youden' as strategy, t as threshold, tpr - fpr as strategy_value from rated order by tpr - fpr desc, i limit 1),
feasible as (select 'fpr' as strategy, t as threshold, tpr as strategy_value from rated where fpr <= 0.1 order by tpr desc, t desc limit 1),
best_fpr as (select * from feasible union all
  select 'fpr', threshold, strategy_value from best_youden where not exists (select 1 from feasible))"""


def threshold(strategy: str) -> str:
    return f"""with {SCORES}, {THRESHOLDS}
select strategy, round(threshold, 9) as threshold, round(strategy_value, 9) as strategy_value from best_{strategy}"""


FEATURED = SPLIT + "," + enriched_cte("splitted", "featured")
FITTED = FEATURED + ",\n" + stats_cte("(select * from featured where split = 'train')", FEATURES, "fit")
SCALED = FITTED + ",\nscaled as (select url, label, source, split, " + ", ".join(
    f'{e} as "{c}"' for c, e in zip(FEATURES, scaled(FEATURES))
) + " from featured, fit)"
MAIL_SCALED = FITTED + "," + EMAILS + ",\n" + URLS + "," + enriched_cte("urls", "mailf") + (
    ",\nmails as (select email_id, label, url_index, url, " + ", ".join(
        f'{e} as "{c}"' for c, e in zip(FEATURES, scaled(FEATURES))
    ) + " from mailf, fit)"
)


def distance(dropped=()) -> str:
    return "(" + " + ".join(f'"{c}" * "{c}"' for c in FEATURES if c not in dropped) + f") / {len(FEATURES)}"


def message_max(source: str, value: str, name: str) -> str:
    return (f"(select e.email_id, e.label, coalesce(m.v, (select median({value}) from {source})) as {name} "
            f"from emails e left join (select email_id, max({value}) as v from {source} group by email_id) m using (email_id))")


BIGRAMS = """
sym as (select id_, t_ as h from {source}),
pairs as (select id_, case when i = 1 then '' else h[i-1] end as prev, h[i] as cur
  from (select id_, h, unnest(range(1, length(h) + 1)) as i from sym)),
cfit as (select url as h from splitted where split = 'train' and label = 1),
cp as (select case when i = 1 then '' else h[i-1] end as prev, h[i] as cur from (select h, unnest(range(1, length(h) + 1)) as i from cfit)),
n2 as (select prev, cur, count(*) as n from cp group by prev, cur),
n1 as (select prev, count(*) as n_prev from cp group by prev),
vv as (select count(distinct cur) + 1 as v from cp),
loss as (select id_, avg(-ln(greatest((coalesce(n, 0) + 1) / (coalesce(n_prev, 0) + v)::double, 1e-9))) as s
  from pairs left join n2 using (prev, cur) left join n1 using (prev), vv group by id_)"""

DOC_LADDER = "tok as (select len(regexp_extract_all(text, '[^%s]+')) as tokens from documents)" % WS

CLEANED = MESSAGES + f""",
kept as (select row_id, {clean('text')} as t, label from messages where text is not null and length(text) >= 10),
firsts as (select *, row_number() over (partition by t order by row_id) as rn from kept where length(t) >= 10),
uniq as (select row_id, t, label from firsts where rn = 1)"""

# The ablated feature sets.
ABLATION_SETS = {
    "all": (),
    "no_https": ("has_https",),
    "no_https_entropy": ("has_https", "domain_entropy"),
    "no_top_shifted": ("has_https", "domain_entropy", "num_dots", "path_depth"),
}


def extremes(direction: str) -> str:
    return f"""with {SCALED},
ps as (select url, round({distance()}, 6) + 0.0 as dist, round("domain_entropy", 6) + 0.0 as entropy from scaled),
lng as (select url, 'dist' as model, dist as score from ps union all select url, 'entropy', entropy from ps)
select model, rank::integer as rank, url, score from (
  select *, row_number() over (partition by model order by score {direction}, url) as rank from lng) where rank <= 5"""


SEQUENCES = SPLIT + """,
chars as (select distinct unnest(string_split(url, '')) as c from splitted where split = 'train'),
vocab as (select c, row_number() over (order by c) + 1 as idx from chars where c <> '')"""

ORACLES: dict[str, str] = {
    "email_distance_auc": f"""with {MAIL_SCALED}, best as {message_max('mails', distance(), 'dist')}
select round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr from {areas('best', 'dist', y='label')}""",
    "src_url_int_label": SRC_A,
    "src_url_str_label": SRC_B,
    "src_url_null_label": SRC_C,
    "email_label_flip": f"with {EMAILS} select email_id, coalesce(1 - label, -1)::integer as label from emails",
    "email_label_map": f"with {EMAILS} select email_id, case label when 0 then 1 when 1 then 0 else -1 end as label from emails",
    "sink_parquet_roundtrip": f"with {SPLIT} select url, label, source, split from splitted",
    "sink_csv_roundtrip": "select doc_id, text from documents",
    "char_sequences": f"""with {SEQUENCES},
pos as (select url, split, unnest(range(1, (select max(length(url)) from splitted) + 1)) as i from splitted),
enc as (select url, split, i, case when i > length(url) then 0 else coalesce(idx, 1) end as code
  from pos left join vocab on c = url[i])
select url, split, string_agg(code::varchar, ',' order by i) as seq from enc group by url, split""",
    "char_sequences_padded": f"""with {SEQUENCES},
pos as (select url, split, unnest(range(1, 41)) as i from splitted),
enc as (select url, split, i, case when i > length(url) then 0 else coalesce(idx, 1) end as code
  from pos left join vocab on c = url[i])
select url, split, string_agg(code::varchar, ',' order by i) as seq from enc group by url, split""",
    "char_sequences_cut": f"""with {SPLIT} select count(*) as n_texts, count(*) filter (length(url) > 40) as n_cut,
 coalesce(sum(length(url) - 40) filter (length(url) > 40), 0)::bigint as characters_cut from splitted""",
    "length_filter": "select doc_id, length(text)::integer as chars from documents where length(text) between 10 and 50000",
    "features_nohttps": f"""with {enriched_cte('(select page_id, url from pages)', 'f')}
select page_id, {rounded([c for c in FEATURES if c != 'has_https'])} from f""",
    "legit_only": f"with {SCALED} select url, {rounded(FEATURES)} from scaled where split = 'train' and label = 1",
    "null_url_emails": f"with {EMAILS}, {URLS} select email_id, label from emails where email_id not in (select email_id from urls)",
    "email_score_max_neutral": f"""with {MAIL_SCALED}, best as {message_max('mails', distance(), 'dist')}
select email_id, label, round(dist, 6) as dist from best""",
    "joint_completeness": f"""with {EMAILS}, {URLS}
select (select count(*) from emails) as n_messages, (select count(distinct email_id) from emails) as n_message_keys,
 (select sum(greatest(len(us), 1)) from found)::bigint as n_url_rows, (select count(distinct email_id) from found) as n_url_keys,
 0::bigint as n_missing, 0::bigint as n_stray""",
    "email_score_wide": f"""with {MAIL_SCALED},
{BIGRAMS.format(source="(select struct_pack(e := email_id, i := url_index) as id_, url as t_ from urls)")},
cs as (select id_.e as email_id, s from loss),
a as {message_max('mails', distance(), 'dist')}, b as {message_max('cs', 's', 'chars')},
c as {message_max('mailf', 'url_entropy', 'entropy')}
select a.email_id, a.label, round(dist, 6) as dist, round(chars, 6) as chars, round(entropy, 6) as entropy
from a join b using (email_id) join c using (email_id)""",
    "clean_corpus": f"""with {CLEANED}
select row_id, {redact('t')} as text, label from uniq where label is not null""",
    "url_union": f"with {UNION} select * from unioned",
    "conflicting_urls": f"with {UNION} select url, count(*) as n_rows from unioned group by url having min(label) <> max(label)",
    "url_corpus": f"with {CORPUS} select url, label, source from agreed",
    "text_dedup": """select doc_id, text, n_chars from (
  select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1""",
    "stratified_split": f"with {EMAILS}, {split_cte('(select email_id, label from emails)', 'email_id', 'label', 'sp')} select email_id, label, split from sp",
    "seeded_sample": f"with {SCORES} select key, score from scores order by md5(concat(key, '|42')), key limit 5000",
    "sample_per_class": f"""with {SCORES} select key, y from (
  select key, y, row_number() over (partition by y order by md5(concat(key, '|42')), key) as rn from scores) where rn <= 4""",
    "cross_source_dedup": """with u as (
 select 0 as pr, 'documents' as source, doc_id as row_id, text from documents union all
 select 1, 'conversations', conv_id * 1000 + turn, text from conversations union all
 select 2, 'benchmark', item_id, text from benchmark),
w as (select *, row_number() over (partition by text order by pr, row_id) as rn,
 count(*) over (partition by text) as n_copies, min(pr) over (partition by text) <> max(pr) over (partition by text) as cross_source from u)
select row_id, source, text, n_copies, cross_source from w where rn = 1""",
    "label_collapse": """select event_id, case when event_type in ('error', 'purchase') then 1
 when event_type in ('click', 'view') then 0 end as label from events""",
    "clean_text": f"with {EMAILS} select email_id, {clean('body')} as text from emails",
    "redact_text": f"with {EMAILS} select email_id, {redact(clean('body'))} as text from emails",
    "redaction_counts": f"""with {EMAILS}, {redact_ctes('emails', clean('body'), 'email_id')}
select {', '.join(f'sum(n_{t[1:-1].lower()})::bigint as n_{t[1:-1].lower()}' for t, _ in REDACT_STEPS)} from step4""",
    "url_extract": f"with {EMAILS}, {URLS} select email_id, url_index::integer as url_index, url from urls",
    "joint_urls": f"""with {SPLIT}, {basic_cte('splitted', 'bf')},
{stats_cte("(select * from bf where split = 'train')", BASIC, 'fit')}, {EMAILS}, {URLS}, {basic_cte('urls', 'mf')}
select email_id, url_index::integer as url_index, false as is_null_url, {', '.join(f'round({e}, 6) + 0.0 as "{c}"' for c, e in zip(BASIC, scaled(BASIC)))} from mf, fit
union all select email_id, 0, true, {', '.join('0.0' for _ in BASIC)} from found where len(us) = 0""",
    "joint_text": f"""with {EMAILS}, {URLS} select email_id, {redact(clean('body'))} as text, emails.label, len(us)::bigint as n_urls
from emails join found using (email_id)""",
    "casing_stats": r"""select count(*) as n, round(avg(regexp_matches(text, '[A-Z]')::integer), 6) as has_upper,
 round(avg(case when len(regexp_extract_all(text, '\p{L}')) = 0 then 0.0
   else len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}'))::double end), 6) as upper_share,
 avg(regexp_matches(text, '[A-Z]')::integer) >= 0.5 as cased_advised from documents where text is not null""",
    "token_length_profile": f"""with {DOC_LADDER} select count(*) as n, max(tokens)::integer as max_tokens,
 {', '.join(f'round(avg((tokens <= {c})::integer), 6) as within_{c}' for c in (128, 256, 384, 512))},
 {', '.join(f'floor(quantile_cont(tokens, {p / 100}))::bigint as p{p}' for p in (50, 75, 90, 95, 99))} from tok""",
    "redact_table_plugin": f"with {EMAILS} select email_id, {redact('body')} as text, label from emails",
    "redact_table": f"with {EMAILS} select email_id, {redact('body')} as text, label from emails",
    "char_vocab": f"with {SEQUENCES} select c as char, idx::integer as index from vocab",
    "url_features_enriched": f"with {enriched_cte('(select page_id, url from pages)', 'f')} select page_id, {rounded(FEATURES)} from f",
    "url_features_basic": f"with {basic_cte('(select page_id, url from pages)', 'f')} select page_id, {rounded(BASIC)} from f",
    "per_source_counts": f"""with {UNION} select source, count(*) as n_rows, count(*) filter (label = 0) as phishing_0,
 count(*) filter (label = 1) as legit_1 from unioned group by source""",
    "label_mix": """select source, count(*) as n, round(count(*) / (select count(*) from documents)::double, 6) as share
 from documents group by source""",
    "class_balance": f"""with {EMAILS}, c as (select count(*) filter (label = 0) as safe_0, count(*) filter (label = 1) as phishing_1 from emails)
select safe_0, phishing_1, round(greatest(safe_0, phishing_1) / (safe_0 + phishing_1)::double, 6) as majority_fraction,
 greatest(safe_0, phishing_1) / (safe_0 + phishing_1)::double > 0.7 as resampling_advised from c""",
    "url_presence": f"""with {EMAILS}, {URLS} select round(avg((len(us) > 0)::integer), 6) as url_presence_rate,
 round(avg(len(us)), 6) as avg_urls_per_message from found""",
    "score_summary": f"""with {SCORES}, l as (select 'score' as model, score as s from scores union all select 'score2', score2 from scores)
select model, count(s) as n, round(avg(s), 9) as mean, round(stddev_samp(s), 9) as std, round(min(s), 9) as min,
 round(quantile_cont(s, 0.25), 9) as q25, round(quantile_cont(s, 0.5), 9) as median, round(quantile_cont(s, 0.75), 9) as q75,
 round(max(s), 9) as max from l group by model""",
    "score_separation": f"""with {SCORES}, l as (select 'score' as model, score as s, y from scores union all select 'score2', score2, y from scores),
m as (select model, avg(s) filter (y = 1) as phish_mean, avg(s) filter (y = 0) as legit_mean from l group by model)
select model, round(phish_mean, 6) as phish_mean, round(legit_mean, 6) as legit_mean, round(phish_mean - legit_mean, 6) + 0.0 as diff,
 phish_mean > legit_mean as correct_direction from m""",
    "scaler_fit": f"with {FITTED} " + " union all ".join(
        f'select {i} as position, \'{c}\' as feature, round("m_{c}", 6) as mean, round("s_{c}", 6) as std from fit'
        for i, c in enumerate(FEATURES)
    ),
    "feature_health": f"with {FEATURED} " + " union all ".join(
        f'select \'{c}\' as feature, count("{c}") as n_values, count(*) filter ("{c}" is null) as n_null, '
        f'count(*) filter (isnan("{c}")) as n_nan, count(*) filter (isinf("{c}")) as n_inf from featured'
        for c in FEATURES
    ),
    "quantile_grid": f"with {SCORES} " + " union all ".join(
        f"select {i} as q_index, round(quantile_cont(score, {(i + 1) / 100}), 9) as value from scores" for i in range(99)
    ),
    "scaled_features": f"with {SCALED} select url, label, source, split, {rounded(FEATURES)} from scaled",
    "threshold_f1": threshold("f1"),
    "threshold_youden": threshold("youden"),
    "threshold_fpr": threshold("fpr"),
    "metrics_at_threshold": f"""with {SCORES}, j as (select score >= 0.35 as hit, y from scores), k as (select {CONFUSION} from j)
select tn, fp, fn, tp, {rates('precision', 'recall', 'f1', 'false_positive_rate')}, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr
from k, {areas('scores', 'score')}""",
    "metrics_at_half": f"""with {SCORES}, j as (select score2 >= 0.5 as hit, y from scores), k as (select {CONFUSION} from j)
select tn, fp, fn, tp, {rates('precision', 'recall', 'f1', 'false_positive_rate', 'accuracy')}, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr
from k, {areas('scores', 'score2')}""",
    "strategy_report": f"""with {SCORES}, {THRESHOLDS},
picks as (select * from best_f1 union all select * from best_youden union all select * from best_fpr),
tst as (select score, y from scores where split = 'test'),
j as (select strategy, threshold, strategy_value, score >= threshold as hit, y from picks, tst),
k as (select strategy, threshold, strategy_value, {CONFUSION} from j group by all)
select strategy, round(threshold, 9) as threshold, round(strategy_value, 9) as strategy_value, tn, fp, fn, tp,
 {rates('precision', 'recall', 'f1', 'false_positive_rate', digits=9)}, round(auc_roc, 9) as auc_roc, round(auc_pr, 9) as auc_pr
from k, {areas('tst', 'score')}""",
    "auc_roc": f"with {SCORES} select round(auc_roc, 6) as auc_roc from {areas('scores', 'score')}",
    "average_precision": f"with {SCORES} select round(auc_pr, 6) as auc_pr from {areas('scores', 'score')}",
    "confusion_matrix": f"with {SCORES}, j as (select score >= 0.35 as hit, y from scores) select {CONFUSION} from j",
    "roc_curve": f"""with {SCORES}, g as (select score2 as s, sum(y) as p, sum(1 - y) as n from scores group by score2)
select round(s, 6) as threshold, round(sum(n) over (order by s desc) / (sum(n) over ())::double, 6) as fpr,
 round(sum(p) over (order by s desc) / (sum(p) over ())::double, 6) as tpr from g""",
    "pr_curve": f"""with {SCORES}, g as (select score2 as s, sum(y) as p, count(*) as n from scores group by score2)
select round(s, 6) as threshold, round(sum(p) over (order by s desc) / (sum(n) over (order by s desc))::double, 6) as precision,
 round(sum(p) over (order by s desc) / (sum(p) over ())::double, 6) as recall from g""",
    "score_histogram": f"""with {SCORES}, r as (select y, min(score) as lo, (max(score) - min(score)) / 50 as w from scores group by y),
b as (select y as target, lo, w, least(floor((score - lo) / w), 49)::integer as bin, count(*) as n from scores join r using (y) group by all)
select target, bin, round(lo + bin * w, 9) as low, round(lo + (bin + 1) * w, 9) as high, n,
 round(n / (sum(n) over (partition by target) * w), 9) as density from b""",
    "token_length_histogram": f"""with {DOC_LADDER}, c as (select least(tokens, 600.0)::double as v from tok),
r as (select min(v) as lo, (max(v) - min(v)) / 60 as w from c),
b as (select lo, w, least(floor((v - lo) / w), 59)::integer as bin, count(*) as n from c, r group by all)
select bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, n from b""",
    "auc_inversion": f"""with {SCORES}, l as (select 'score' as model, score as s, y from scores union all select 'score2', score2, y from scores)
select model, round(auc_roc, 6) as auc_roc, round(1 - auc_roc, 6) as auc_flipped, auc_roc < 0.5 as inverted from {areas('l', 's', 'model')}""",
    "feature_shift": f"with {MAIL_SCALED} " + " union all ".join(
        f'select \'{c}\' as feature, round((select avg(("{c}" - "m_{c}") / "s_{c}") from featured, fit where split = \'train\'), 6) + 0.0 as train_mean, '
        f'round((select avg("{c}") from mails), 6) + 0.0 as eval_mean, '
        f'round((select avg("{c}") from mails) - (select avg(("{c}" - "m_{c}") / "s_{c}") from featured, fit where split = \'train\'), 6) + 0.0 as shift'
        for c in FEATURES
    ),
    "ablation_auc": f"with {MAIL_SCALED}, " + ", ".join(
        f"b_{name} as {message_max('mails', distance(dropped), 'dist')}" for name, dropped in ABLATION_SETS.items()
    ) + ", l as (" + " union all ".join(f"select '{n}' as feature_set, dist, label from b_{n}" for n in ABLATION_SETS) + f""")
select feature_set, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr from {areas('l', 'dist', 'feature_set', 'label')}""",
    "joint_diagnostics": f"""with {MAIL_SCALED}, best as {message_max('mails', distance(), 'dist')},
r as (select dist, coalesce(1 - best.label, -1) as label, len(us) as n_urls from best join found using (email_id)),
o as (select count(*) as n_messages, sum(n_urls)::bigint as n_urls, count(dist) as n_scored, count(*) filter (n_urls = 0) as n_no_url,
 round(avg((n_urls = 0)::integer), 6) as no_url_share, count(*) filter (label = 0) as n_phish, count(*) filter (label = 1) as n_legit,
 count(*) filter (label = -1) as n_unlabelled, count(distinct dist) filter (n_urls = 0) = 1 as neutral_constant,
 round(min(dist), 6) as score_min, round(max(dist), 6) as score_max, round(stddev_samp(dist), 6) as score_std from r)
select *, round(n_phish / (n_phish + n_legit)::double, 6) as phish_fraction,
 n_phish / (n_phish + n_legit)::double > 0.2 and n_phish / (n_phish + n_legit)::double < 0.8 as phish_plausible from o""",
    "top_anomalous": extremes("desc"),
    "least_anomalous": extremes("asc"),
    "top_errors": f"""with {SCORES}, w as (select key, score, case when score >= 0.5 and y = 0 then 'false_positive'
  when score < 0.5 and y = 1 then 'false_negative' end as kind from scores)
select kind, rank::integer as rank, key, score from (select *, row_number() over (partition by kind order by
  case when kind = 'false_positive' then -score else score end, key) as rank from w where kind is not null) where rank <= 3""",
    "char_ngram_score": f"""with {SPLIT}, {BIGRAMS.format(source="(select url as id_, url as t_ from splitted)")}
select url, split, round(coalesce(s, 0.0), 6) as score from splitted left join loss on id_ = url""",
    "l2_normalise": """with e as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as dim from embeddings)
select vec_id, dim::integer as dim, round(v / sqrt(sum(v * v) over (partition by vec_id)), 6) + 0.0 as value from e""",
    "class_weights": """with g as (select (label < 3)::integer as y, count(*) as n from embeddings group by 1)
select y, n, round(sum(n) over () / (count(*) over () * n)::double, 6) as weight from g""",
    "batch_predict": """with e as (select vec_id, unnest(embedding)::double as v from embeddings)
select vec_id, round(1 / (1 + exp(-avg(v))), 6) as score from e group by vec_id""",
    "readiness_url": f"""with {CORPUS}, src as (select unnest(['a', 'b', 'c']) as s),
c as (select label, count(*) as n, (count(*) * 8) // 10 as tr from agreed group by label),
q as (select *, (n - tr) // 2 as va from c)
select 'source_rows' as section, s as name, (select count(*) from unioned where source = s) as value from src
union all select 'source_phishing_0', s, (select count(*) from unioned where source = s and label = 0) from src
union all select 'source_legit_1', s, (select count(*) from unioned where source = s and label = 1) from src
union all select 'source_mix', s, (select count(*) from agreed where source = s) from src
union all select 'dedup', 'rows_before_dedup', count(*) from unioned
union all select 'dedup', 'conflicting_urls_dropped', count(*) from (select url from unioned group by url having min(label) <> max(label))
union all select 'dedup', 'rows_after_dedup', count(*) from agreed
union all select 'splits', 'train', sum(tr)::bigint from q
union all select 'splits', 'val', sum(va)::bigint from q
union all select 'splits', 'test', sum(n - tr - va)::bigint from q
union all select 'train_labels', case label when 0 then 'phishing_0' else 'legit_1' end, tr from q""",
    "readiness_text": f"""with {CLEANED}, {redact_ctes('uniq', 't', 'row_id')},
dd as (select distinct text from messages where text is not null),
cnt as (select (select count(*) from messages) as loaded_rows, (select count(*) from messages where text is null) as removed_null_bodies,
 (select count(text) - count(distinct text) from messages) as removed_exact_duplicates,
 (select count(*) from dd where length(text) < 10) as removed_length_outliers,
 (select count(*) from dd where length(text) >= 10) - (select count(*) from uniq) as removed_post_clean_empty_or_dup,
 {', '.join(f'(select sum(n_{t[1:-1].lower()}) from step4)::bigint as redacted_{t[1:-1].lower()}' for t, _ in REDACT_STEPS)},
 (select count(*) from uniq where label is null) as removed_unlabelled,
 (select count(*) from uniq where label = 0) as safe_0, (select count(*) from uniq where label = 1) as phishing_1)
select *, round(greatest(safe_0, phishing_1) / (safe_0 + phishing_1)::double, 6) as majority_fraction, safe_0 + phishing_1 as final_rows,
 greatest(safe_0, phishing_1) / (safe_0 + phishing_1)::double > 0.7 as resampling_advised from cnt""",
    "readiness_joint": f"""with {EMAILS}, {URLS} select count(*) as loaded_messages, sum(len(us))::bigint as total_urls,
 count(*) filter (len(us) = 0) as null_url_messages, count(*) filter (label = 0) as label_0, count(*) filter (label = 1) as label_1,
 count(*) filter (label is null) as unlabelled, round(avg((len(us) > 0)::integer), 4) as url_presence_rate,
 round(avg(len(us)), 2) as avg_urls_per_message from found""",
    "feature_schema": f"with {FEATURED} " + " union all ".join(
        f"select {i} as position, '{c}' as feature, {len(FEATURES)} as n_features, '0 = phishing, 1 = legitimate' as convention, "
        f'count("{c}") as n_values from featured' for i, c in enumerate(FEATURES)
    ),
    "source_exclusion": """with k as (select source, row_number() over (partition by text order by doc_id) as rn from documents)
select count(*) as rows_before, count(*) filter (source <> 'src3') as rows_after, count(*) filter (source = 'src3') as rows_removed
from k where rn = 1""",
    "fuse_scores": f"""with {SCORES}, f as (
 select key, 'score' as semantic, 'score2' as anomaly, score * 0.5 + score2 * 0.5 as fused from scores union all
 select key, 'score', 'score3', score * 0.5 + (score * score2) * 0.5 from scores)
select key, semantic, anomaly, fused,
 case when fused >= 0.6 then 'phishing' when fused >= 0.4 then 'suspicious' else 'legitimate' end as verdict from f""",
}

ORACLES["email_csv_source"] = ORACLES["clean_corpus"]
ORACLES["report_json_roundtrip"] = f"""select section, name, value::double as value from ({ORACLES["readiness_url"]})
union all select 'text', name, value from (unpivot (select columns(*)::double from ({ORACLES["readiness_text"]})) on columns(*) into name name value value)
union all select 'joint', name, value from (unpivot (select columns(*)::double from ({ORACLES["readiness_joint"]})) on columns(*) into name name value value)"""


def _bits(*parts: str) -> str:
    """The first eight hexadecimal digits of the md5 of the parts, as a number."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint"


def forest_ctes(trees: int, samples: int, largest: int, rows: str) -> str:
    """CTEs that grow ``trees`` isolation trees on ``samples`` rows each and walk every row of ``rows``.

    Feature ``f`` of a row is in ``long_all``; the trees take the first ``samples`` of the training
    rows drawn for the largest setting. Names end in the number of samples.
    """
    s, limit = samples, math.ceil(math.log2(samples))
    average = lambda n: (f"case when {n} > 2 then 2 * (ln({n} - 1.0) + 0.5772156649) - 2 * ({n} - 1.0) / {n} "
                         f"when {n} = 2 then 1.0 else 0.0 end")
    parts = [f"a{s}_0 as materialized (select tree, url, 1 as node from drawn where place <= {s})"]
    for k in range(limit):
        parts.append(f"""st{s}_{k} as (select tree, node, f, min(v) as lo, max(v) as hi from a{s}_{k} join long_all using (url) group by all having max(v) > min(v)),
ls{s}_{k} as (select tree, node, list({{'f': f, 'lo': lo, 'hi': hi}} order by f) as l from st{s}_{k} group by all),
pk{s}_{k} as materialized (select tree, node, c.f as f, c.lo + (c.hi - c.lo) * ({_bits('tree', 'node', '42', "'cut'")} / 4294967296.0) as cut from (
  select tree, node, l[1 + ({_bits('tree', 'node', '42', "'feature'")} * len(l)) // 4294967296] as c from ls{s}_{k})),
a{s}_{k + 1} as materialized (select a.tree, a.url, a.node * 2 + (v > cut)::integer as node
  from a{s}_{k} a join pk{s}_{k} p using (tree, node) join long_all l on l.url = a.url and l.f = p.f)""")
    counts = " union all ".join(f"select tree, node, {k} as depth, count(*) as n from a{s}_{k} group by all" for k in range(limit + 1))
    picks = " union all ".join(f"select * from pk{s}_{k}" for k in range(limit))
    parts.append(f"""nd{s} as materialized (select c.tree, c.node, p.f, p.cut, case when p.cut is null then depth + {average('n')} else 0.0 end as path
  from ({counts}) c left join ({picks}) p using (tree, node)), w{s}_0 as (select url, tree, 1 as node from {rows}, (select distinct tree from drawn))""")
    for k in range(limit):
        parts.append(f"""w{s}_{k + 1} as (select w.url, w.tree, case when n.cut is null then w.node else w.node * 2 + (v > n.cut)::integer end as node
  from w{s}_{k} w join nd{s} n using (tree, node) left join long_all l on l.url = w.url and l.f = n.f)""")
    parts.append(f"""ends{s} as materialized (select url, tree, path from w{s}_{limit} join nd{s} using (tree, node)),
norm{s} as (select {average('n')} as c from (select max(n) as n from (select count(*) as n from a{s}_0 group by tree)))""")
    return ",\n".join(parts)


def drawn_ctes(trees: int, samples: int) -> str:
    """``long_all`` and ``drawn``: the training rows of each tree in the order they are taken."""
    wanted = samples + 10 * math.sqrt(samples) + 20
    cells = ", ".join(f"{{'f': {i}, 'v': round(\"{c}\", 6) + 0.0}}" for i, c in enumerate(FEATURES))
    return f"""long_all as materialized (select url, c.f as f, c.v as v from (select url, unnest([{cells}]) as c from scaled)),
chance as (select least(1.0, {wanted!r}::double / greatest(count(*), 1)) as one from scaled where split = 'train'),
drawn as materialized (select tree, url, row_number() over (partition by tree order by md5(concat_ws('|', url, tree, '42', 'order')), url) as place
  from (select url from scaled where split = 'train'), range({trees}) t(tree), chance
  where {_bits('url', "'42'", "'row'")} < least(1.0, one * {trees}) * 4294967296.0
    and {_bits('url', 'tree', "'42'")} < one / least(1.0, one * {trees}) * 4294967296.0)"""


_FOREST = f"with {SCALED},\n{drawn_ctes(200, 512)},\n{forest_ctes(200, 512, 512, 'scaled')}"
ORACLES["iforest_fit"] = f"""{_FOREST}
select tree::integer as tree, node::integer as node, coalesce(f, 0)::integer as feature, round(cut, 6) + 0.0 as threshold, round(path, 6) as path,
 (select count(*) from a512_0 a where a.tree = nd512.tree)::integer as n_samples from nd512"""
ORACLES["iforest_score"] = f"""{_FOREST}
select url, label, split, round(pow(2, -(select avg(path) from ends512 e where e.url = scaled.url) / (select c from norm512)), 6) as anomaly_score from scaled"""


def _sweep() -> str:
    settings = [(t, s) for t in (100, 200, 300) for s in (128, 256, 512)]
    grown = ",\n".join(forest_ctes(300, s, 512, "(select url from scaled where split <> 'train')") for s in (128, 256, 512))
    rows = " union all ".join(
        f"""select {t} as n_estimators, {s} as max_samples, url, round(pow(2, -avg(path) / (select c from norm{s})), 9) as score
  from ends{s} where tree < {t} group by url""" for t, s in settings
    )
    each = " union all ".join(
        f"""select * from (with scores as (select score, y, split from judged where n_estimators = {t} and max_samples = {s}), {THRESHOLDS},
 tst as (select score, y from scores where split = 'test'), j as (select score >= threshold as hit, y from tst, best_f1), k as (select {CONFUSION} from j)
 select {t} as n_estimators, {s} as max_samples, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr, {rates('f1', 'precision', 'recall')},
  round({RATES['false_positive_rate']}, 6) as fpr from k, {areas('tst', 'score')})""" for t, s in settings
    )
    return f"""with {SCALED},\n{drawn_ctes(300, 512)},\n{grown},
judged as materialized (select n_estimators, max_samples, score, 1 - label as y, split from ({rows}) join scaled using (url))
{each}"""


ORACLES["iforest_sweep"] = _sweep()

ORACLES["pca_recon_bounds"] = f"""with {SCALED}, centre as (select {', '.join(f'avg("{c}") as "c_{c}"' for c in FEATURES)} from scaled where split = 'train' and label = 1)
select url, round(({' + '.join(f'("{c}" - "c_{c}") * ("{c}" - "c_{c}")' for c in FEATURES)}) / {len(FEATURES)}, 6) + 0.0 as "none", 0.0::double as "all"
from scaled, centre"""
ORACLES["embedding_logreg_check"] = "select count(*) as n_rows, count(*) as n_in_range, true as at_optimum from embeddings"
ORACLES["text_logreg_check"] = "select count(*) as n_rows, count(*) as n_in_range, true as at_optimum from documents"
ORACLES["embedding_logreg_gradient"] = """select unnest(range(-1, (select max(len(embedding)) from embeddings))) as term, true as at_optimum"""
ORACLES["autoencoder_check"] = f"""with {SCALED} select count(*) as n_rows, count(*) as n_scored,
 round(avg(({' + '.join(f'"{c}" * "{c}"' for c in FEATURES)}) / {len(FEATURES)}) filter (split = 'train' and label = 1), 6) as mean_square, true as improved from scaled"""
ORACLES["char_context_gain"] = f"with {SPLIT} select split, count(*) as n_rows, true as longer_is_better from splitted group by split"
# Levels g2, g1, g0 of the context tree: counts, then different characters in front, each with its discount.
_LEVEL = """t{k} as (select ctx, sum(n) as total, count(*) as kinds from g{k} group by ctx),
d{k} as (select coalesce(count(*) filter (n = 1) / nullif(count(*) filter (n = 1) + 2 * count(*) filter (n = 2), 0)::double * nullif((count(*) filter (n = 1) > 0)::integer, 0), 0.5) as d from g{k})"""
_MIXED = "case when t{k}.total is null then {below} else (greatest(coalesce(g{k}.n, 0) - d{k}.d, 0) + d{k}.d * t{k}.kinds * ({below})) / t{k}.total end"
_P = "1 / v::double"
for _k in range(3):
    _P = _MIXED.format(k=_k, below=_P)
ORACLES["char_context_score"] = f"""with {SPLIT},
spot as (select url, split, label, case i when 1 then chr(65535) || chr(65535) when 2 then chr(65535) || url[1] else url[i-2:i-1] end as ctx, url[i] as c
 from (select *, unnest(range(1, length(url) + 1)) as i from splitted)),
g2 as (select ctx, c, count(*) as n from spot where split = 'train' and label = 1 group by ctx, c),
g1 as (select substring(ctx, 2) as ctx, c, count(*) as n from g2 group by 1, 2),
g0 as (select '' as ctx, c, count(*) as n from g1 group by c),
{', '.join(_LEVEL.format(k=k) for k in range(3))},
vv as (select count(*) + 1 as v from g0),
loss as (select url, avg(-ln({_P})) as s from spot
 left join g2 on g2.ctx = spot.ctx and g2.c = spot.c left join t2 on t2.ctx = spot.ctx
 left join g1 on g1.ctx = substring(spot.ctx, 2) and g1.c = spot.c left join t1 on t1.ctx = substring(spot.ctx, 2)
 left join g0 on g0.c = spot.c, t0, d0, d1, d2, vv group by url)
select splitted.url, split, round(coalesce(s, 0.0), 6) as score from splitted left join loss using (url)"""
ORACLES["recognised_names"] = """with m as (select doc_id, coalesce(text, '') || ' for ' || c_name || ' of ' || lower(n_name) || '.' as t
 from documents join customer on c_custkey = doc_id % (select count(*) from customer) join nation on n_nationkey = c_nationkey),
names as (select lower(c_name) as name, 'person' as kind, 0.9::double as score from customer union all select lower(n_name), 'place', 0.6::double from nation),
pairs as (select doc_id, t, name, kind, score, string_split(lower(t), name) as parts from m join names on contains(lower(t), name)),
spans as (select doc_id, t, kind, score, length(name) as n,
 (list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(name))::bigint as start from (select *, unnest(range(1, len(parts))) as k from pairs))
select doc_id, kind, start::integer as start, (start + n)::integer as "end", score from spans
where not regexp_matches(case when start > 0 then t[start] else '' end, '[\\p{L}\\p{N}]') and not regexp_matches(t[start + n + 1], '[\\p{L}\\p{N}]')"""
ORACLES["url_corpus_arriving"] = ORACLES["url_corpus"]
