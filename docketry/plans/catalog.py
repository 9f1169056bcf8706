"""The relational catalogue: one SQL text per query, for Spark and for the checking engine.

The texts are ANSI SQL over the star schema.  Where the two dialects differ a
macro in braces stands for the difference (``MACROS``); tables stand in braces,
too.  Every aggregate is cast and named, every limit has a unique order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.functions.fixed import CATEGORY_LABELS, HIDDEN_NAMES, HIDDEN_PATTERNS, MERGED_NAMES, NO_FEED_HEADLINES, TYPE_LABELS, any_of
from docketry.tables import load

TABLES = {"a": "enforcement_actions", "d": "defendants", "ad": "action_defendants", "vc": "violation_categories", "mt": "monetary_terms", "sr": "scrape_runs", "ss": "state_sites", "dm": "dedup_matches"}

#: (Spark, DuckDB) forms of macros; %s are their arguments.
MACROS = {
    "mon": ("date_format(%s, 'MMM yyyy')", "strftime(%s, '%%b %%Y')"),
    "month": ("date_format(%s, 'yyyy-MM')", "strftime(%s, '%%Y-%%m')"),
    "concat_set": ("nullif(array_join(array_sort(collect_set(%s)), '; '), '')", "string_agg(DISTINCT %s, '; ' ORDER BY %s)"),
    "text": ("string", "varchar"),
    "label": ("initcap(replace(%s, '_', ' '))", "array_to_string(list_transform(string_split(replace(%s, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
    "days": ("datediff(%s, %s)", "date_diff('day', %s, %s)"),
    "fixed1": ("format_string('%%.1f', %s)", "printf('%%.1f', %s)"),
    "rlike": ("%s RLIKE r%s", "regexp_matches(%s, %s)"),
    "first_by": ("min_by(%s, struct(-%s, %s))", "arg_min(%s, (-%s, %s))"),
    "path": ("parse_url(%s, 'PATH')", "regexp_replace(%s, '^[a-z]+://[^/]+', '')"),
}
_MACRO = re.compile(r"\{(\w+):([^{}]*)\}")


def expand(text: str, dialect: int, tables: dict[str, str] | None = None) -> str:
    def one(m):
        args = [x.strip() for x in m[2].split(";;")] if m[2] else []
        form = MACROS[m[1]][dialect]
        n = form.replace("%%", "").count("%s")
        return form % tuple((args * n)[:n])

    text = text.replace("{text}", MACROS["text"][dialect])
    while _MACRO.search(text):
        text = _MACRO.sub(one, text)
    for k, v in (tables or {}).items():
        text = text.replace("{%s}" % k, v)
    return text.replace("\x01", "{").replace("\x02", "}")


#: Children of an action as one text each, in order; what is null is left out.
CHILDREN = """
LEFT JOIN (SELECT x.action_id, {concat_set:concat(y.raw_name, ' | ', coalesce(y.canonical_name, ''), ' | ', coalesce(x.role, ''))} AS parties FROM {ad} x JOIN {d} y ON y.id = x.defendant_id GROUP BY x.action_id) d ON d.action_id = a.id
LEFT JOIN (SELECT action_id, {concat_set:concat(category, ' | ', coalesce(subcategory, ''), ' | ', coalesce(CAST(confidence AS {text}), ''))} AS categories FROM {vc} GROUP BY action_id) c ON c.action_id = a.id"""


def _sql(pattern: str) -> str:
    """A pattern as a literal that both dialects read alike; the macro puts Spark's backslashes in."""
    return "'" + pattern.replace("'", "''").replace("{", "\x01").replace("}", "\x02") + "'"


def _labels(column: str, labels: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {other} END"


ACTIVE = "quality_score > 0.1"
ENFORCEMENT = "quality_score > 0.1 AND NOT coalesce(is_federal_litigation, false)"
#: Rows of one state and day beyond this are taken for misdated.
MISDATED = 30

#: Names as the dashboard shows them: without those that are none, variants under one name.
MERGED = f"""
SELECT {_labels('company', MERGED_NAMES, 'company')} AS name, company, actions, states, state_list FROM (
  SELECT d.canonical_name AS company, count(DISTINCT a.id) AS actions, count(DISTINCT a.state) AS states, {{concat_set:a.state}} AS state_list
  FROM {{d}} d JOIN {{ad}} x ON x.defendant_id = d.id JOIN {{a}} a ON a.id = x.action_id WHERE {ENFORCEMENT} AND length(d.canonical_name) > 3 GROUP BY d.canonical_name) y
WHERE lower(trim(company)) NOT IN ({", ".join("'%s'" % n for n in HIDDEN_NAMES)}) AND NOT {{rlike:company;;{_sql(any_of(HIDDEN_PATTERNS))}}}"""
#: Of merged names the list of the variant with most actions stands.
FIRST_LIST = "{first_by:state_list;;actions;;company}"

SQL: dict[str, str] = {
    # --- storage and API -------------------------------------------------
    "o01_action_exists": "SELECT u.url, a.id IS NOT NULL AS known FROM (SELECT min(source_url) AS url FROM {a} UNION ALL SELECT 'https://nowhere.example/none' AS url) u LEFT JOIN {a} a ON a.source_url = u.url",
    "o02_action_count": "SELECT state, CAST(count(*) AS BIGINT) AS actions FROM {a} GROUP BY state",
    "o03_db_stats": "SELECT (SELECT count(*) FROM {a}) AS actions, (SELECT count(*) FROM {d}) AS defendants, (SELECT count(DISTINCT state) FROM {a}) AS states, (SELECT count(DISTINCT id) FROM {sr}) AS runs",
    "o04_scrape_run": "SELECT DISTINCT id, state, started_at, completed_at, press_releases_found, actions_extracted, errors FROM {sr} WHERE id = (SELECT min(id) FROM {sr})",
    "o05_list_actions": """
SELECT a.id, a.state, a.date_announced, a.action_type, a.status, a.headline, CAST(m.total_amount AS DOUBLE) AS total_amount,
       CAST(coalesce(n.n, 0) AS BIGINT) AS defendants, CAST(coalesce(c.n, 0) AS BIGINT) AS categories
FROM {a} a LEFT JOIN {mt} m ON m.action_id = a.id
LEFT JOIN (SELECT action_id, count(DISTINCT defendant_id) AS n FROM {ad} GROUP BY action_id) n ON n.action_id = a.id
LEFT JOIN (SELECT action_id, count(DISTINCT category) AS n FROM {vc} GROUP BY action_id) c ON c.action_id = a.id
WHERE a.state IN ('CA', 'NY') AND a.date_announced BETWEEN DATE '2019-06-01' AND DATE '2024-12-31' AND lower(a.headline) LIKE '%to%'
  AND EXISTS (SELECT 1 FROM {vc} v WHERE v.action_id = a.id AND v.category = 'consumer_protection') AND m.total_amount >= 1000
  AND EXISTS (SELECT 1 FROM {ad} x JOIN {d} y ON y.id = x.defendant_id WHERE x.action_id = a.id AND (lower(y.raw_name) LIKE '%s%' OR lower(y.canonical_name) LIKE '%s%'))
ORDER BY a.date_announced DESC, a.id LIMIT 50""",
    "o06_get_action": f"""
SELECT a.id, a.state, a.date_announced, a.action_type, a.status, a.headline, a.source_url, a.is_multistate, a.quality_score, a.raw_text, CAST(m.total_amount AS DOUBLE) AS total_amount, CAST(nullif(m.civil_penalty, 0) AS DOUBLE) AS civil_penalty,
       CAST(nullif(m.consumer_restitution, 0) AS DOUBLE) AS consumer_restitution, CAST(nullif(m.fees_and_costs, 0) AS DOUBLE) AS fees_and_costs, m.amount_is_estimated, d.parties, c.categories
FROM {{a}} a LEFT JOIN {{mt}} m ON m.action_id = a.id {CHILDREN}""",
    "o07_stats_totals": "SELECT (SELECT count(*) FROM {a}) AS total_actions, (SELECT count(*) FROM {d}) AS total_defendants, (SELECT CAST(coalesce(sum(total_amount), 0) AS DOUBLE) FROM {mt}) AS total_amount",
    "o08_stats_by_state": "SELECT state, CAST(count(*) AS BIGINT) AS actions FROM {a} GROUP BY state ORDER BY actions DESC, state",
    "o09_stats_by_type": "SELECT action_type, CAST(count(*) AS BIGINT) AS actions FROM {a} GROUP BY action_type",
    "o10_stats_by_category": "SELECT category, CAST(count(*) AS BIGINT) AS n FROM {vc} GROUP BY category ORDER BY n DESC, category",
    "o11_top_defendants": "SELECT d.canonical_name, CAST(count(x.action_id) AS BIGINT) AS actions FROM {d} d JOIN {ad} x ON x.defendant_id = d.id WHERE d.canonical_name <> '' GROUP BY d.canonical_name ORDER BY actions DESC, d.canonical_name LIMIT 20",
    "o12_timeline_month": "SELECT {month:date_announced} AS period, CAST(count(*) AS BIGINT) AS actions FROM {a} GROUP BY 1 ORDER BY 1",
    "o13_timeline_quarter": "SELECT concat(CAST(year(date_announced) AS {text}), '-Q', CAST(quarter(date_announced) AS {text})) AS period, CAST(count(*) AS BIGINT) AS actions FROM {a} WHERE state = 'CA' GROUP BY 1 ORDER BY 1",
    "o14_timeline_year": "SELECT CAST(year(a.date_announced) AS INT) AS period, CAST(count(*) AS BIGINT) AS actions FROM {a} a WHERE EXISTS (SELECT 1 FROM {vc} v WHERE v.action_id = a.id AND v.category = 'healthcare') GROUP BY 1 ORDER BY 1",
    "o15_list_states": "SELECT a.state, CAST(count(*) AS BIGINT) AS actions, CAST(coalesce(sum(m.total_amount), 0) AS DOUBLE) AS total_amount FROM {a} a LEFT JOIN {mt} m ON m.action_id = a.id GROUP BY a.state ORDER BY a.state",
    "o16_export_api": """
SELECT a.id, a.state, a.date_announced, a.action_type, a.status, a.headline, a.source_url, d.names AS defendants, c.categories, CAST(m.total_amount AS DOUBLE) AS total_amount, a.is_multistate, a.quality_score
FROM {a} a LEFT JOIN {mt} m ON m.action_id = a.id
LEFT JOIN (SELECT x.action_id, {concat_set:coalesce(nullif(y.canonical_name, ''), y.raw_name)} AS names FROM {ad} x JOIN {d} y ON y.id = x.defendant_id GROUP BY x.action_id) d ON d.action_id = a.id
LEFT JOIN (SELECT action_id, {concat_set:category} AS categories FROM {vc} GROUP BY action_id) c ON c.action_id = a.id
WHERE a.date_announced >= DATE '2020-01-01'""",
    "o17_export_rows": """
SELECT a.id, a.state, a.date_announced, a.date_filed, a.action_type, a.status, a.headline, a.source_url, a.is_multistate, a.is_federal_litigation, a.quality_score, a.extraction_method, d.names AS defendants, c.categories,
       CAST(m.total_amount AS DOUBLE) AS total_amount, CAST(m.civil_penalty AS DOUBLE) AS civil_penalty, CAST(m.consumer_restitution AS DOUBLE) AS restitution, m.amount_is_estimated
FROM {a} a LEFT JOIN {mt} m ON m.action_id = a.id
LEFT JOIN (SELECT x.action_id, {concat_set:coalesce(nullif(y.canonical_name, ''), y.raw_name)} AS names FROM {ad} x JOIN {d} y ON y.id = x.defendant_id GROUP BY x.action_id) d ON d.action_id = a.id
LEFT JOIN (SELECT action_id, {concat_set:category} AS categories FROM {vc} GROUP BY action_id) c ON c.action_id = a.id""",
    "o18_export_clean": """
SELECT a.id, s.state_name, a.date_announced, {label:a.action_type} AS action_type, a.headline, d.names AS defendants, c.categories,
       CASE WHEN coalesce(m.total_amount, 0) = 0 THEN '' WHEN m.total_amount = floor(m.total_amount) THEN CAST(CAST(m.total_amount AS BIGINT) AS {text}) ELSE CAST(m.total_amount AS {text}) END AS amount, a.source_url
FROM {a} a LEFT JOIN {ss} s ON s.state = a.state LEFT JOIN {mt} m ON m.action_id = a.id
LEFT JOIN (SELECT x.action_id, {concat_set:coalesce(nullif(y.canonical_name, ''), y.raw_name)} AS names FROM {ad} x JOIN {d} y ON y.id = x.defendant_id GROUP BY x.action_id) d ON d.action_id = a.id
LEFT JOIN (SELECT action_id, {concat_set:{label:category}} AS categories FROM {vc} GROUP BY action_id) c ON c.action_id = a.id
WHERE a.quality_score >= 0.5 AND NOT coalesce(a.is_federal_litigation, false)""",
    # --- report ------------------------------------------------------------
    "o19_report_overview": f"""
SELECT (SELECT count(*) FROM {{a}}) AS stored, (SELECT count(*) FROM {{a}} WHERE {ACTIVE}) AS active, (SELECT count(*) FROM {{a}} WHERE quality_score <= 0.1) AS filtered,
       (SELECT count(*) FROM {{d}}) AS defendants, (SELECT CAST(coalesce(sum(m.total_amount), 0) AS DOUBLE) FROM {{mt}} m JOIN {{a}} a ON a.id = m.action_id WHERE {ACTIVE}) AS total_amount,
       (SELECT count(DISTINCT state) FROM {{a}} WHERE {ACTIVE}) AS states, (SELECT count(*) FROM {{a}} WHERE {ACTIVE} AND is_multistate) AS multistate""",
    "o20_report_coverage": f"SELECT state, CAST(count(*) AS BIGINT) AS actions, min(date_announced) AS first_date, max(date_announced) AS last_date FROM {{a}} WHERE {ACTIVE} GROUP BY state",
    "o21_report_by_state": f"SELECT state, CAST(count(*) AS BIGINT) AS actions, round(1e2 * count(*) / sum(count(*)) OVER (), 4) AS share FROM {{a}} WHERE {ACTIVE} GROUP BY state",
    "o24_report_categories": "SELECT category, CAST(count(*) AS BIGINT) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 4) AS share FROM {vc} GROUP BY category",
    "o25_report_types": f"""
SELECT t.action_type, t.actions, round(1e2 * t.actions / s.n, 4) AS share, round(CAST(s.settlements AS DOUBLE) / s.lawsuits, 4) AS settlements_per_lawsuit
FROM (SELECT action_type, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE {ACTIVE} GROUP BY action_type) t
CROSS JOIN (SELECT count(*) AS n, count_if(action_type = 'settlement') AS settlements, nullif(count_if(action_type = 'lawsuit_filed'), 0) AS lawsuits FROM {{a}} WHERE {ACTIVE}) s""",
    "o26_cross_state_defendants": "SELECT d.canonical_name, CAST(count(DISTINCT a.state) AS BIGINT) AS states, {concat_set:a.state} AS state_list, CAST(count(x.action_id) AS BIGINT) AS actions FROM {d} d JOIN {ad} x ON x.defendant_id = d.id JOIN {a} a ON a.id = x.action_id WHERE d.canonical_name <> '' GROUP BY d.canonical_name HAVING count(DISTINCT a.state) > 1",
    "o27_money_by_category": "SELECT v.category, CAST(sum(m.total_amount) AS DOUBLE) AS total_amount, CAST(count(DISTINCT a.id) AS BIGINT) AS actions, round(CAST(sum(m.total_amount) AS DOUBLE) / count(DISTINCT a.id), 2) AS average FROM {vc} v JOIN {a} a ON a.id = v.action_id JOIN {mt} m ON m.action_id = a.id WHERE m.total_amount > 0 GROUP BY v.category",
    "o28_quarterly_trend": f"SELECT concat(CAST(year(date_announced) AS {{text}}), '-Q', CAST(quarter(date_announced) AS {{text}})) AS period, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE {ACTIVE} AND date_announced >= DATE '2022-01-01' GROUP BY 1",
    "o29_year_over_year": f"""
SELECT y AS year, actions, previous, CASE WHEN previous > 0 THEN round(1e2 * (actions - previous) / previous, 2) END AS change_pct FROM (
  SELECT y, actions, lag(actions) OVER (ORDER BY y) AS previous, row_number() OVER (ORDER BY y DESC) AS r
  FROM (SELECT CAST(year(date_announced) AS INT) AS y, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE {ACTIVE} AND date_announced >= DATE '2022-01-01' GROUP BY 1) t) u WHERE r = 1""",
    "o30_quality_histogram": f"SELECT h.bucket, h.actions, round(g.mean, 4) AS active_mean FROM (SELECT round(quality_score, 1) AS bucket, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE quality_score IS NOT NULL GROUP BY 1) h CROSS JOIN (SELECT avg(quality_score) AS mean FROM {{a}} WHERE {ACTIVE}) g",
    # --- dashboard ------------------------------------------------------------
    "o31_dash_actions": f"SELECT id, state, date_announced, CAST(year(date_announced) AS INT) AS year, {{month:date_announced}} AS month, {{mon:date_announced}} AS month_label, action_type, {_labels('action_type', TYPE_LABELS, '{label:action_type}')} AS type_label, status, headline, is_multistate, quality_score FROM {{a}} WHERE {ENFORCEMENT}",
    "o32_dash_monetary": f"SELECT a.id, a.state, a.date_announced, a.headline, a.is_multistate, CAST(m.total_amount AS DOUBLE) AS amount FROM {{a}} a JOIN {{mt}} m ON m.action_id = a.id WHERE {ENFORCEMENT} AND m.total_amount > 0",
    "o34_dash_categories": f"SELECT v.action_id, a.state, a.date_announced, v.category, {_labels('v.category', CATEGORY_LABELS, 'v.category')} AS label FROM {{vc}} v JOIN {{a}} a ON a.id = v.action_id WHERE {ENFORCEMENT} AND v.category <> 'other'",
    "o35_dash_defendants": f"""
SELECT name, CAST(sum(actions) AS BIGINT) AS actions, CAST(max(states) AS BIGINT) AS states, {FIRST_LIST} AS state_list FROM ({MERGED}) z GROUP BY name""",
    "o36_multistate_targets": f"SELECT d.canonical_name AS name, CAST(count(DISTINCT a.state) AS BIGINT) AS states, {{concat_set:a.state}} AS state_list, CAST(count(DISTINCT a.id) AS BIGINT) AS actions FROM {{d}} d JOIN {{ad}} x ON x.defendant_id = d.id JOIN {{a}} a ON a.id = x.action_id WHERE {ENFORCEMENT} AND d.canonical_name <> '' GROUP BY d.canonical_name HAVING count(DISTINCT a.state) >= 3 ORDER BY states DESC, actions DESC, name",
    "o37_dash_coverage": f"SELECT state, CAST(count(*) AS BIGINT) AS stored, CAST(sum(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS active, min(date_announced) AS first_date, max(date_announced) AS last_date, round(1e2 * sum(CASE WHEN {ACTIVE} THEN 0 ELSE 1 END) / count(*), 2) AS filtered_pct FROM {{a}} GROUP BY state HAVING sum(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END) > 10",
    "o38_company_search": f"SELECT coalesce(nullif(d.canonical_name, ''), d.raw_name) AS name, CAST(count(DISTINCT a.id) AS BIGINT) AS actions, CAST(count(DISTINCT a.state) AS BIGINT) AS states, CAST(coalesce(sum(m.total_amount), 0) AS DOUBLE) AS amount FROM {{d}} d JOIN (SELECT DISTINCT action_id, defendant_id FROM {{ad}}) x ON x.defendant_id = d.id JOIN {{a}} a ON a.id = x.action_id LEFT JOIN {{mt}} m ON m.action_id = a.id WHERE {ENFORCEMENT} AND lower(coalesce(nullif(d.canonical_name, ''), d.raw_name)) LIKE '%energy%' GROUP BY 1",
    "o39_multistate_stats": f"SELECT CAST(count(*) AS BIGINT) AS actions, CAST(sum(CASE WHEN is_multistate THEN 1 ELSE 0 END) AS BIGINT) AS multistate, round(1e2 * sum(CASE WHEN is_multistate THEN 1 ELSE 0 END) / count(*), 4) AS pct, (SELECT round(avg(n), 4) FROM (SELECT count(DISTINCT a.state) AS n FROM {{d}} d JOIN {{ad}} x ON x.defendant_id = d.id JOIN {{a}} a ON a.id = x.action_id WHERE {ENFORCEMENT} AND d.canonical_name <> '' GROUP BY d.canonical_name HAVING count(DISTINCT a.state) >= 3) t) AS average_states FROM {{a}} WHERE {ENFORCEMENT}",
    "o40_recent_feed": f"""
SELECT t.id, t.state, t.date_announced, t.headline, CAST(coalesce(m.total_amount, 0) AS DOUBLE) AS amount FROM (
  SELECT id, state, date_announced, headline, row_number() OVER (PARTITION BY headline ORDER BY date_announced DESC, id) AS r FROM {{a}} WHERE {ENFORCEMENT} AND action_type <> 'other' AND headline IS NOT NULL AND NOT {{rlike:headline;;{_sql(any_of(NO_FEED_HEADLINES))}}}) t
LEFT JOIN {{mt}} m ON m.action_id = t.id WHERE r = 1 ORDER BY t.date_announced DESC, t.id LIMIT 20""",
    "o41_state_volume": f"SELECT state, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE {ENFORCEMENT} GROUP BY state",
    "o42_category_top": f"SELECT v.category, CAST(count(*) AS BIGINT) AS n FROM {{vc}} v JOIN {{a}} a ON a.id = v.action_id WHERE {ENFORCEMENT} AND v.category <> 'other' GROUP BY v.category ORDER BY n DESC, v.category LIMIT 10",
    "o43_category_trend": f"""
WITH c AS (SELECT v.category, CAST(year(a.date_announced) AS INT) AS year, count(*) OVER (PARTITION BY a.state, a.date_announced) AS same_day FROM {{vc}} v JOIN {{a}} a ON a.id = v.action_id
           WHERE {ENFORCEMENT} AND v.category <> 'other' AND a.date_announced >= DATE '2022-01-01' AND a.date_announced < DATE '2027-01-01'),
k AS (SELECT category, year FROM c WHERE same_day <= {MISDATED}), top AS (SELECT category FROM k GROUP BY category ORDER BY count(*) DESC, category LIMIT 6)
SELECT k.category, k.year, CAST(count(*) AS BIGINT) AS n FROM k JOIN top t ON t.category = k.category GROUP BY k.category, k.year""",
    "o44_dash_types": f"SELECT {_labels('action_type', TYPE_LABELS, '{label:action_type}')} AS action_type, CAST(count(*) AS BIGINT) AS actions FROM {{a}} WHERE {ENFORCEMENT} AND action_type <> 'other' GROUP BY 1",
    "o45_yearly_stacked": f"""
SELECT year, CAST(count(*) AS BIGINT) AS actions, CAST(sum(CASE WHEN is_multistate THEN 1 ELSE 0 END) AS BIGINT) AS multistate, CAST(sum(CASE WHEN is_multistate THEN 0 ELSE 1 END) AS BIGINT) AS single FROM (
  SELECT CAST(year(date_announced) AS INT) AS year, is_multistate, count(*) OVER (PARTITION BY state, date_announced) AS same_day FROM {{a}}
  WHERE {ENFORCEMENT} AND date_announced >= DATE '2022-01-01' AND date_announced < DATE '2027-01-01') t WHERE same_day <= {MISDATED} GROUP BY year""",
    "o46_top_defendants": f"SELECT name, CAST(sum(actions) AS BIGINT) AS actions FROM ({MERGED}) z GROUP BY name ORDER BY actions DESC, name LIMIT 15",
    "o47_quality_report": """
SELECT (SELECT count(*) FROM {a}) AS actions, (SELECT count(*) FROM {a} WHERE quality_score <= 0.1) AS low_quality, (SELECT count(DISTINCT action_id) FROM {ad}) AS with_defendants,
       (SELECT count(DISTINCT action_id) FROM {mt}) AS with_amounts, (SELECT count(*) FROM {d} WHERE coalesce(canonical_name, '') = '') AS without_canonical""",
    "o48_configured_states": "SELECT s.state, s.state_name, s.host, CAST(count(a.id) AS BIGINT) AS actions FROM {ss} s LEFT JOIN {a} a ON a.state = s.state GROUP BY s.state, s.state_name, s.host",
    # --- operators that the queries above don't show ---------------------------
    "d06_conditional_sums": "SELECT state, CAST(count_if(is_multistate) AS BIGINT) AS multistate, CAST(count_if(coalesce(is_federal_litigation, false)) AS BIGINT) AS federal, bool_or(is_multistate) AS any_multistate FROM {a} GROUP BY state",
    "d15_mid_amount": "SELECT category, CAST(total_amount AS DOUBLE) AS mid_amount FROM (SELECT v.category, m.total_amount, row_number() OVER (PARTITION BY v.category ORDER BY m.total_amount DESC) AS r, count(*) OVER (PARTITION BY v.category) AS n FROM (SELECT DISTINCT action_id, category FROM {vc}) v JOIN {mt} m ON m.action_id = v.action_id) x WHERE r = CAST(floor(n / 2) AS INT) + 1",
    "e04_first_announced": "SELECT d.canonical_name, min(a.date_announced) AS first_date, min(CASE WHEN a.date_announced = f.first_date THEN a.id END) AS first_id FROM {d} d JOIN {ad} x ON x.defendant_id = d.id JOIN {a} a ON a.id = x.action_id JOIN (SELECT d2.canonical_name AS n, min(a2.date_announced) AS first_date FROM {d} d2 JOIN {ad} x2 ON x2.defendant_id = d2.id JOIN {a} a2 ON a2.id = x2.action_id GROUP BY 1) f ON f.n = d.canonical_name WHERE d.canonical_name <> '' GROUP BY d.canonical_name",
    "g01_url_paths": "SELECT {path:source_url} AS path, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT replace(source_url, 'http://', 'https://')) AS BIGINT) AS urls FROM {a} GROUP BY 1",
    "h04_amount_labels": "SELECT action_id, CASE WHEN total_amount >= 1000000000 THEN concat('$', {fixed1:CAST(total_amount AS DOUBLE) / 1000000000}, 'B') WHEN total_amount >= 1000000 THEN concat('$', {fixed1:CAST(total_amount AS DOUBLE) / 1000000}, 'M') WHEN total_amount >= 1000 THEN concat('$', CAST(CAST(floor(total_amount / 1000) AS BIGINT) AS {text}), 'K') WHEN total_amount > 0 THEN concat('$', CAST(CAST(floor(total_amount) AS BIGINT) AS {text})) ELSE '' END AS label, CASE WHEN total_amount > 100000000 THEN 'large' WHEN total_amount >= 1000000 THEN 'mid' WHEN total_amount > 0 THEN 'small' ELSE 'none' END AS bucket FROM {mt}",
    "h05_truncated_headlines": "SELECT id, CASE WHEN length(headline) > 60 THEN concat(substr(headline, 1, 57), '...') ELSE headline END AS short, CASE WHEN length(headline) > 80 THEN concat(regexp_replace(substr(headline, 1, 77), '[ ][^ ]*$', ''), '...') ELSE headline END AS words FROM {a}",
    "l03_amount_ratio": "SELECT x.action_id AS id_a, y.action_id AS id_b, round(CAST(least(x.total_amount, y.total_amount) AS DOUBLE) / CAST(greatest(x.total_amount, y.total_amount) AS DOUBLE), 6) AS ratio FROM {dm} m JOIN {mt} x ON x.action_id = m.action_id_a JOIN {mt} y ON y.action_id = m.action_id_b WHERE x.total_amount > 0 AND y.total_amount > 0",
    "b08_waiting": "SELECT state, CAST(count(*) AS BIGINT) AS n FROM {a} WHERE raw_text <> '' AND quality_score = 0 GROUP BY state",
    "b12_by_address": "SELECT s.state, CAST(count(*) AS BIGINT) AS n FROM {a} a JOIN {ss} s ON s.state = a.state WHERE a.source_url LIKE concat('https://', s.host, '/%') GROUP BY s.state",
    "h24_coverage_labels": f"SELECT state, concat({{mon:min(date_announced)}}, ' – ', {{mon:max(date_announced)}}) AS dates, concat({{fixed1:1e2 * sum(CASE WHEN {ACTIVE} THEN 0 ELSE 1 END) / count(*)}}, '%') AS filtered FROM {{a}} GROUP BY state",
    "m02_duplicate_urls": "SELECT source_url, CAST(count(*) AS BIGINT) AS n FROM {a} GROUP BY source_url HAVING count(*) > 1",
    "m04_run_totals": "SELECT state, CAST(count(*) AS BIGINT) AS runs, CAST(sum(press_releases_found) AS BIGINT) AS found, CAST(sum(actions_extracted) AS BIGINT) AS extracted, CAST(sum(errors) AS BIGINT) AS errors, CAST(count_if(completed_at IS NULL) AS BIGINT) AS unfinished FROM (SELECT DISTINCT * FROM {sr}) r GROUP BY state",
    "x01_cube": "SELECT state, action_type, CAST(year(date_announced) AS INT) AS year, CAST(count(*) AS BIGINT) AS actions, CAST(grouping(state) AS INT) AS all_states, CAST(grouping(action_type) AS INT) AS all_types FROM {a} GROUP BY GROUPING SETS ((state, action_type, year(date_announced)), (state, action_type), (state), ())".replace("CAST(year(date_announced) AS INT) AS year", "year(date_announced) AS year"),
}


def run(spark: SparkSession, root: str, text: str, **more: DataFrame) -> DataFrame:
    """A catalogue text over the tables in ``root``; ``more`` replaces or adds tables."""
    used = {k: more.get(k) if k in more else load(spark, root, TABLES[k]) for k in [*TABLES, *more] if "{%s}" % k in text}
    return spark.sql(expand(text, 0), **used)


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: run(spark, root, text)


QUERIES = {name: _query(text) for name, text in SQL.items()}
ORACLES = {name: expand(text, 1, TABLES) for name, text in SQL.items()}
