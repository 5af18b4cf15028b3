"""The SQL twin of each query, over the same tables."""

import re

from ledgerlake import schema as S
from ledgerlake.functions import text
from ledgerlake.functions.rules import rule_table
from ledgerlake.operators import labelled
from ledgerlake.sources import alerts
from ledgerlake.workload import views as V


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _pick(values: list[str], n: str) -> str:
    return f"({_list(values)})[CAST(({n}) % {len(values)} AS INT) + 1]"


def _rules(column: str, as_coded: bool = False) -> str:
    branches = " ".join(
        f"WHEN regexp_matches({column}, {_text('(?i)' + pattern)}) THEN {_text(name)}"
        for _, pattern, name in rule_table(as_coded)
    )
    return f"CASE {branches} END"


# The marked patterns; this engine has no flag for Unicode classes.
_NOISE = text.NOISE_WORDS.replace("(?iU)", "(?i)")
_BUSINESS = text.BUSINESS_WORDS.replace("(?iU)", "(?i)")

_GATEWAY = text.GATEWAY_PREFIX.replace("(?iU)", "(?i)")
_LONG_NUMBER = text.LONG_NUMBER.replace("(?U)", "")
_CURRENCY_FIRST, _VERB_FIRST, _RECEIVER = (
    p.replace("(?id)", "(?i)") for p in (alerts.CURRENCY_FIRST, alerts.VERB_FIRST, alerts.RECEIVER)
)

_LABELS = _list(S.LABELS)
_KEYS = "user_key, merchant_key"
_FOLDED = "strip_accents(lower(text))"



def _draw(name: str) -> str:
    """Number in [0, 1) from the hash of case, sample, seed and name."""
    return f"CAST('0x' || substr(sha256(concat_ws('|', case_id, sample, 42, '{name}')), 1, 12) AS BIGINT) / {float(16**12)}"


# Named tables; each may use the others.
CTES = {
    "pay": f"""
        SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, ts, k,
               CAST(CASE WHEN k % 4 = 0 THEN 100 + k ELSE value END AS DECIMAL(18, 2)) AS amount,
               {_pick(V.RECEIVERS, 'k')} AS receiver
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)""",
    "txn_raw": """
        SELECT event_id * 2 AS raw_id, user_id, amount, receiver, ts, 'gmail' AS source FROM pay
        UNION ALL
        SELECT event_id * 2 + 1, user_id, amount, receiver, date_trunc('day', ts), 'file'
        FROM pay WHERE event_type = 'purchase'""",
    "printed": """
        SELECT *, sha256(user_id || '|' || CAST(amount AS VARCHAR) || '|'
               || lower(trim(receiver)) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS fingerprint
        FROM txn_raw""",
    "bronze": """
        SELECT * FROM printed
        QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY raw_id) = 1""",
    "earlier": f"""
        SELECT * FROM printed
        WHERE ts < TIMESTAMP '{V.PREVIOUS_RUN}' AND source = 'gmail'
        QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY raw_id) = 1""",
    "named": r"""
        SELECT receiver, CASE WHEN regexp_matches(receiver, '(?i)@|VPA|UPI') AND length(x) >= 3
                 THEN trim(regexp_replace(x, '\s+[A-Z]\s*$', '')) END AS name
        FROM (SELECT receiver, trim(regexp_replace(
                 trim(regexp_replace(receiver, '(?i)^vpa\s*', '')), '\S+@\S+\s*', '', 'g')) AS x
              FROM (SELECT DISTINCT receiver FROM pay))""",
    "generic": r"""
        SELECT receiver, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                 regexp_replace(regexp_replace(receiver, '(?i)^[a-z0-9]{6,}\s+', ''),
                   '(?i)\b(Mr|Mrs|Miss|Dr|Shri)\b\.?\s*', '', 'g'),
                 '[/@]\S+', '', 'g'), '\d{6,}', '', 'g'),
                 '(?i)\b(UPI|NEFT|IMPS|RTGS|VPA)\b', '', 'g'), '\s+', ' ', 'g')) AS plain
        FROM named""",
    "merchants": f"""
        SELECT receiver, coalesce({_rules('coalesce(name, receiver)')},
                 trim(regexp_replace(name, '\\s+', ' ', 'g')),
                 nullif(plain, ''), 'Unknown') AS merchant
        FROM named JOIN generic USING (receiver)""",
    "silver": """
        SELECT raw_id AS silver_id, user_id, amount, merchant, receiver, ts,
               CAST(ts AS DATE) AS transaction_date, source
        FROM bronze JOIN merchants USING (receiver)""",
    "prepared": rf"""
        SELECT receiver, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                 regexp_replace(CASE WHEN length(after) >= 3 THEN after ELSE bare END,
                   '{_GATEWAY}', ' ', 'g'),
                 '{text.SEPARATORS}', ' ', 'g'), '{_LONG_NUMBER}', ' ', 'g'),
                 '{_NOISE}', ' ', 'g'), '\s+', ' ', 'g'))) AS prepared
        FROM (SELECT *, trim(regexp_replace(bare, '\S+@\S+\s*', '', 'g')) AS after
              FROM (SELECT DISTINCT receiver,
                      trim(regexp_replace(receiver, '(?i)^VPA\s+', '')) AS bare FROM pay))""",
    "persons": rf"""
        SELECT receiver, regexp_matches(x,
                 '^[A-Za-z]{{2,}}\s+[A-Za-z]{{2,}}(\s+[A-Za-z]{{2,}})?$')
               AND NOT regexp_matches(x, '{_BUSINESS}') AS person
        FROM (SELECT DISTINCT receiver, trim(regexp_replace(receiver, '\S+@\S+\s*', '', 'g')) AS x
              FROM pay)""",
    "feedback": f"""
        SELECT user_id, event_id * 2 AS silver_id, merchant, receiver AS raw_text,
               {_pick(S.CATEGORIES, 'k + CAST(user_id AS INT)')} AS corrected_category,
               amount, ts AS corrected_at
        FROM pay JOIN merchants USING (receiver) WHERE event_type IN ('click', 'view')""",
    "keyed": r"""
        SELECT *, lower(trim(user_id)) AS user_key,
               regexp_replace(lower(trim(merchant)), '\s+', ' ', 'g') AS merchant_key
        FROM feedback""",
    "weighted": f"""
        SELECT {_KEYS}, corrected_category AS category, sum(power(0.85, pos)) AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}
                ORDER BY corrected_at DESC, silver_id DESC) - 1 AS pos FROM keyed)
        GROUP BY ALL""",
    "latest": f"""
        SELECT {_KEYS}, corrected_category AS override FROM keyed
        QUALIFY row_number() OVER (PARTITION BY {_KEYS}
                ORDER BY corrected_at DESC, silver_id DESC) = 1""",
    "spread": f"""
        SELECT {_KEYS}, count(*) AS amount_count, avg(CAST(amount AS DOUBLE)) AS amount_mean,
               stddev_pop(CAST(amount AS DOUBLE)) AS amount_std
        FROM keyed WHERE amount > 0 GROUP BY ALL""",
    "profile": f"""
        SELECT {_KEYS}, override, n AS history_count, total AS weight_total, amount_count,
               CASE WHEN amount_mean > 0 THEN amount_std / amount_mean ELSE 1 END AS amount_cv
        FROM latest
        JOIN (SELECT {_KEYS}, sum(weight) AS total FROM weighted GROUP BY ALL) USING ({_KEYS})
        JOIN (SELECT {_KEYS}, count(*) AS n FROM keyed GROUP BY ALL) USING ({_KEYS})
        LEFT JOIN spread USING ({_KEYS})""",
    "scored": r"""
        SELECT event_id AS txn_id, user_id, receiver, merchant, amount, ts, person,
               lower(trim(user_id)) AS user_key,
               regexp_replace(lower(trim(merchant)), '\s+', ' ', 'g') AS merchant_key
        FROM pay JOIN merchants USING (receiver) JOIN persons USING (receiver)""",
    "proba": f"""
        SELECT txn_id, {_LABELS}[i + 1] AS category,
               power(1 + (txn_id * 31 + i * 17) % 97, 4)
                 / sum(power(1 + (txn_id * 31 + i * 17) % 97, 4)) OVER (PARTITION BY txn_id) AS p
        FROM (SELECT event_id AS txn_id, unnest(range(13)) AS i FROM events)""",
    "boosted": """
        SELECT txn_id, category, q / sum(q) OVER (PARTITION BY txn_id) AS p
        FROM (SELECT txn_id, category, p + CASE
                WHEN category = 'Food' AND amount <= 500
                     AND (hour(ts) BETWEEN 11 AND 15 OR hour(ts) BETWEEN 19 AND 22) THEN 0.25
                WHEN category = 'Subscription' AND history_count >= 3 AND amount_count >= 3
                     AND amount_cv < 0.15 THEN 0.30
                WHEN category = 'Transfer' AND person AND amount <= 5000 THEN 0.20
                ELSE 0 END AS q
              FROM proba JOIN scored USING (txn_id)
              LEFT JOIN profile USING (user_key, merchant_key))""",
    "corrections": f"""
        SELECT CASE WHEN k = 7 THEN -event_id ELSE event_id * 2 END AS silver_id, user_id,
               receiver AS merchant, {_pick(S.CATEGORIES + ['Pets'], 'k')} AS corrected_category,
               amount, ts AS corrected_at
        FROM pay WHERE event_type = 'error'""",
    "accepted": f"""
        SELECT c.*, s.transaction_date, d.category AS original_category
        FROM corrections c JOIN silver s USING (silver_id, user_id)
        LEFT JOIN stored d USING (silver_id)
        WHERE corrected_category IN ({_list(S.CATEGORIES)[1:-1]})
        QUALIFY row_number() OVER (PARTITION BY silver_id, c.user_id
                                   ORDER BY corrected_at DESC) = 1""",
    "stored": """
        SELECT silver_id, user_id, amount, transaction_date,
               CASE WHEN category <> 'Other' THEN category END AS category,
               category <> 'Other' AS is_categorised, confidence, decision_source
        FROM decided JOIN silver USING (silver_id)""",
    "corrected": """
        SELECT s.silver_id, s.user_id, s.amount, s.transaction_date,
               coalesce(a.corrected_category, s.category) AS category,
               a.silver_id IS NOT NULL OR s.is_categorised AS is_categorised,
               a.silver_id IS NOT NULL AS user_corrected
        FROM stored s LEFT JOIN accepted a USING (silver_id, user_id)""",
    "orders_gold": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS user_id,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               {_pick(S.CATEGORIES, 'o_orderkey')} AS category,
               sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total_amount, count(*) AS txn_count
        FROM orders GROUP BY ALL""",
    "newest_month": """
        SELECT * FROM orders_gold
        QUALIFY month = max(month) OVER (PARTITION BY user_id)""",
    "lines": f"""
        SELECT o_orderkey AS line_id, CAST(o_custkey AS VARCHAR) AS user_id,
               CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
                    ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d,
               CASE WHEN o_orderkey % 13 <> 0 THEN {_pick(V.RECEIVERS, 'o_orderkey')} END AS n,
               CASE WHEN o_orderkey % 10 <> 0
                    THEN format('{{:,.2f}}', CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE) END AS w
        FROM orders""",
    "statement": """
        SELECT line_id, user_id, CAST(replace(w, ',', '') AS DOUBLE) AS amount,
               coalesce(n, '') AS raw_text, try_strptime(d, '%d/%m/%Y') AS "timestamp",
               coalesce(n, 'UNKNOWN') AS receiver, 'debit' AS transaction_type,
               'file' AS source
        FROM lines WHERE w IS NOT NULL AND try_strptime(d, '%d/%m/%Y') IS NOT NULL
          AND CAST(replace(w, ',', '') AS DOUBLE) > 0""",
    "messages": f"""
        SELECT 'm' || event_id AS message_id, user_id, {_pick(V.SENDERS, 'event_id')} AS sender,
               ts AS sent_at,
               CASE WHEN event_id % 7 = 0 THEN 'Rs. ' || amount || ' offer' || dest
                    WHEN event_id % 5 = 0 THEN 'You have spent Rs. ' || amount || dest
                    WHEN event_id % 3 = 0 THEN 'INR ' || format('{{:,.2f}}', amount::DOUBLE)
                         || chr(13) || chr(10) || 'debited by transfer. Ref on file'
                    ELSE 'Rs. ' || amount || ' debited from a/c' || dest END AS body
        FROM (SELECT *, ' to ' || receiver || ' on ' || strftime(ts, '%d-%m-%Y') AS dest
              FROM pay)""",
    "mail": rf"""
        SELECT message_id, user_id, CAST(replace(a, ',', '') AS DOUBLE) AS amount,
               CASE WHEN regexp_matches(body, '{_RECEIVER}')
                    THEN trim(regexp_extract(body, '{_RECEIVER}', 1))
                    ELSE 'UNKNOWN' END AS receiver,
               'debit' AS transaction_type, sent_at AS "timestamp", 'gmail' AS source,
               body AS raw_text
        FROM (SELECT *, coalesce(
                nullif(regexp_extract(body,
                  '{_CURRENCY_FIRST}', 1), ''),
                nullif(regexp_extract(body,
                  '{_VERB_FIRST}', 1), '')) AS a
              FROM messages WHERE regexp_matches(body, '{alerts.DEBIT_WORD}'))
        WHERE a IS NOT NULL AND CAST(replace(a, ',', '') AS DOUBLE) > 0""",
    "marks": """
        SELECT user_id, last_fetched, unnest(['gmail', 'file']) AS source
        FROM (SELECT user_id, min(ts) AS last_fetched
              FROM pay WHERE event_type = 'signup' GROUP BY user_id)""",
    "labelled": f"""
        SELECT event_id AS example_id, receiver AS raw_text, user_id, amount, ts,
               {_pick(S.CATEGORIES, f'k % {len(V.RECEIVERS)}')} AS category FROM pay""",
    "counts": "SELECT category, count(*) AS n FROM labelled GROUP BY category",
    "ranked": """
        SELECT example_id, category, row_number() OVER (PARTITION BY category
               ORDER BY example_id) - 1 AS r FROM labelled""",
    "words": rf"""
        SELECT doc_id, regexp_extract_all({_FOLDED}, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+') AS w
        FROM documents""",
    "word_terms": """
        SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest(w) AS term FROM words
          UNION ALL
          SELECT doc_id, a || ' ' || b FROM (
            SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM words
            WHERE len(w) > 1))
        GROUP BY doc_id, term""",
    "terms": """
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM word_terms GROUP BY term""",
    "vocab": f"""
        SELECT term, df, cf, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
        FROM terms WHERE df >= 2 ORDER BY cf DESC, term LIMIT {S.WORD_VOCABULARY_MAX}""",
    "centroids": """
        SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x
        FROM (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m
              FROM (SELECT label, embedding, unnest(range(len(embedding))) AS i FROM embeddings)
              GROUP BY label, i)""",
    "anchors": f"""
        SELECT {_pick(S.LABELS, 'label')} AS label, list(x ORDER BY i) AS anchor
        FROM centroids GROUP BY ALL""",
    "cold": """
        SELECT vec_id, label, exp(10 * (s - max(s) OVER (PARTITION BY vec_id)))
               / sum(exp(10 * s)) OVER (PARTITION BY vec_id)
               * exp(10 * max(s) OVER (PARTITION BY vec_id)) AS p
        FROM (SELECT vec_id, a.label,
                list_cosine_similarity(CAST(embedding AS DOUBLE[]), a.anchor) AS s
              FROM embeddings, anchors a)""",
    "cold_decided": """
        SELECT vec_id, CASE WHEN p < 0.25 THEN 'Other' ELSE label END AS category,
               p AS confidence
        FROM cold QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) = 1""",
    "decided_plain": """
        SELECT txn_id, category, confidence, decision_source FROM (
          SELECT txn_id, CASE WHEN strong OR p >= 0.25 THEN category ELSE 'Other' END AS category,
                 CASE WHEN strong THEN greatest(p, 0.6) ELSE p END AS confidence,
                 CASE WHEN category = 'Other' OR NOT (strong OR p >= 0.25) THEN 'low_confidence'
                      WHEN override IS NOT NULL THEN 'override' ELSE 'ml+history' END
                   AS decision_source
          FROM (SELECT *, coalesce(weight_total, 0) >= 3 AS strong
                FROM proba JOIN scored USING (txn_id)
                LEFT JOIN profile USING (user_key, merchant_key))
          QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY p DESC, category) = 1)""",
}

# The full cascade: boosts, history, override, decision.
CTES["biased"] = """
    SELECT txn_id, category, q / sum(q) OVER (PARTITION BY txn_id) AS p
    FROM (SELECT b.txn_id, b.category,
            CASE WHEN weight_total > 0
                 THEN 0.6 * b.p + 0.4 * coalesce(w.weight, 0) / weight_total
                 ELSE b.p END AS q
          FROM {source} b JOIN scored USING (txn_id)
          LEFT JOIN profile USING (user_key, merchant_key)
          LEFT JOIN weighted w USING (user_key, merchant_key, category))"""
CTES["pulled"] = """
    SELECT txn_id, category, q / sum(q) OVER (PARTITION BY txn_id) AS p
    FROM (SELECT b.txn_id, b.category,
            CASE WHEN override IS NULL THEN b.p
                 ELSE 0.25 * b.p + CASE WHEN override = b.category THEN 0.75 ELSE 0 END END AS q
          FROM {source} b JOIN scored USING (txn_id)
          LEFT JOIN profile USING (user_key, merchant_key))"""
for _name, _source in (("biased", "proba"), ("pulled", "proba")):
    CTES[f"{_name}_only"] = CTES[_name].replace("{source}", _source)
CTES["biased"] = CTES["biased"].replace("{source}", "boosted")
CTES["pulled"] = CTES["pulled"].replace("{source}", "biased")
CTES["decided"] = CTES["decided_plain"].replace("FROM proba", "FROM pulled").replace(
    "SELECT txn_id, category, confidence",
    "SELECT txn_id * 2 AS silver_id, category, confidence", 1
)


def _needed(sql: str, seen: dict[str, None]) -> None:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", sql) and _is_table(name, sql):
            _needed(CTES[name], seen)
            seen.setdefault(name)


def _is_table(name: str, sql: str) -> bool:
    return re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql) is not None


def _query(sql: str) -> str:
    seen: dict[str, None] = {}
    _needed(sql, seen)
    if not seen:
        return sql.strip()
    tables = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in seen)
    return f"WITH {tables}\n{sql.strip()}"


_GOLD = """
    SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, category,
           CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS txn_count
    FROM {table} WHERE is_categorised GROUP BY ALL"""
_BRONZE = """
    SELECT raw_id AS bronze_id, raw_id, user_id, CAST(amount AS DOUBLE) AS amount, receiver,
           ts AS "timestamp", source, fingerprint, false AS is_duplicate FROM bronze"""
_WRITTEN = """
    SELECT silver_id, user_id, category, is_categorised,
           round(confidence, 6) AS confidence, decision_source FROM stored"""
_TRAILING = """
    SELECT event_id, merchant, user_id, amount, ts,
           count(*) OVER recent AS freq_30d, avg(CAST(amount AS DOUBLE)) OVER recent AS mean,
           stddev_pop(CAST(amount AS DOUBLE)) OVER recent AS std
    FROM pay JOIN merchants USING (receiver)
    WINDOW recent AS (PARTITION BY user_id, merchant ORDER BY ts
      RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""
_PREDICTED = """
    SELECT example_id, l.category AS actual, d.category AS predicted, event_type
    FROM labelled l JOIN decided_plain d ON example_id = txn_id
    JOIN events ON event_id = example_id"""
_TEXT_WEIGHTS = r"""
        WITH texts AS (SELECT prepared AS text, count(*) AS copies
                       FROM pay JOIN prepared USING (receiver) GROUP BY prepared),
        grams AS (
          SELECT text, 'char' AS analyser, g AS term
          FROM (SELECT text, unnest(flatten([[w[i:i + size - 1]
                  for i in range(1, length(w) - size + 2)] for size in [2, 3, 4, 5]])) AS g
                FROM (SELECT text, ' ' || w || ' ' AS w
                      FROM (SELECT text, unnest(string_split(text, ' ')) AS w FROM texts)
                      WHERE w <> ''))
          UNION ALL
          SELECT text, 'word', unnest(regexp_extract_all(text, '\w\w+')) FROM texts
          UNION ALL
          SELECT text, 'word', a || ' ' || b
          FROM (SELECT text, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b
                FROM (SELECT text, regexp_extract_all(text, '\w\w+') AS w FROM texts)
                WHERE len(w) > 1)),
        tf AS (SELECT text, analyser, term, count(*) AS tf FROM grams GROUP BY ALL),
        idf AS (SELECT analyser, term, ln((1 + (SELECT sum(copies) FROM texts))
                  / (1 + sum(copies))) + 1 AS idf
                FROM tf JOIN texts USING (text) GROUP BY ALL HAVING sum(copies) >= 2)
        SELECT text, analyser, term,
               w / sqrt(sum(w * w) OVER (PARTITION BY text, analyser)) AS weight
        FROM (SELECT text, analyser, term, (1 + ln(tf)) * idf AS w
              FROM tf JOIN idf USING (analyser, term))"""


def _online_sql(steps: int) -> str:
    """Steps on the batches ``example_id % steps`` from the made model, and the
    probabilities of all examples after the last one."""
    names = ["constant", "log_amount", "hour_sin", "hour_cos", "weekday"]
    values = ["1.0", "ln(1 + CAST(amount AS DOUBLE))", "sin(2 * pi() * hour(ts) / 24)",
              "cos(2 * pi() * hour(ts) / 24)", "(isodow(ts) - 1) / 6"]
    made = [[V.MADE_INTERCEPTS[i], *V.MADE_TAIL[i][:4]] for i in range(len(S.LABELS))]
    rows = ", ".join(
        f"('{c}', '{name}', {made[i][k]!r})" for i, c in enumerate(S.LABELS) for k, name in enumerate(names)
    )
    drawn = (
        "CAST('0x' || substr(sha256(concat_ws('|', analyser, term, label)), 1, 12) AS BIGINT)"
        f" / {float(16**12)} - 0.5"
    )
    def scores(i: int, where: str = "") -> str:
        return f"""
        s{i} AS (SELECT text, label, sum(weight * w) AS s FROM weights JOIN t{i} USING (analyser, term) GROUP BY ALL),
        p{i} AS (
          SELECT e.example_id, e.text, m.label, e.category,
                 1 / (1 + exp(-(sum(e.x * m.w) + coalesce(any_value(s.s), 0)))) AS p
          FROM examples e JOIN m{i} m USING (name) LEFT JOIN s{i} s ON s.text = e.text AND s.label = m.label {where}
          GROUP BY e.example_id, e.text, m.label, e.category)"""

    parts = [f"""
        WITH weights AS ({_TEXT_WEIGHTS}),
        examples AS (
          SELECT event_id AS example_id, prepared AS text, category,
                 unnest({names}) AS name, unnest([{', '.join(values)}]) AS x
          FROM pay JOIN prepared USING (receiver)
          JOIN (SELECT example_id AS event_id, category FROM labelled) USING (event_id)),
        labels AS (SELECT unnest({_LABELS}) AS label),
        t0 AS (SELECT analyser, term, label, {drawn} AS w, 0.01 AS g
               FROM (SELECT DISTINCT analyser, term FROM weights), labels),
        m0 AS (SELECT *, 0.01 AS g FROM (VALUES {rows}) AS l(label, name, w))"""]
    for i in range(steps):
        parts.append(scores(i, f"WHERE e.example_id % {steps} = {i}"))
        parts.append(f"""
        r{i} AS (SELECT example_id, text, label, p - CAST(label = category AS INT) AS r,
                        (SELECT count(DISTINCT example_id) FROM p{i}) AS n FROM p{i}),
        d{i} AS (SELECT analyser, term, label, sum(weight * r) / any_value(n) AS d
                 FROM weights JOIN (SELECT text, label, sum(r) AS r, any_value(n) AS n FROM r{i} GROUP BY ALL) USING (text)
                 GROUP BY ALL),
        f{i} AS (SELECT name, label, sum(x * r) / any_value(n) AS d FROM r{i} JOIN examples USING (example_id) GROUP BY ALL),
        t{i + 1} AS (SELECT analyser, term, label, w - coalesce(0.5 * d / sqrt(g + d * d), 0) AS w, g + coalesce(d * d, 0) AS g
                     FROM t{i} LEFT JOIN d{i} USING (analyser, term, label)),
        m{i + 1} AS (SELECT label, name, w - 0.5 * d / sqrt(g + d * d) AS w, g + d * d AS g
                     FROM m{i} JOIN f{i} USING (label, name))""")
    parts.append(scores(steps))
    return ",".join(parts) + f"""
        SELECT example_id, label AS category, round(p / sum(p) OVER (PARTITION BY example_id), 6) AS p FROM p{steps}"""


_LONG = "SELECT txn_id, category, round(p, 6) AS p FROM {table}"

_SQL = {
    "spend_by_merchant": """
        SELECT user_id, month, merchant, CAST(total AS DOUBLE) AS total_amount, txn_count,
               round(CAST(total AS DOUBLE)
                 / CAST(sum(total) OVER (PARTITION BY user_id, month) AS DOUBLE), 6) AS share
        FROM (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                     merchant, sum(amount) AS total, count(*) AS txn_count
              FROM silver GROUP BY ALL)""",
    "statement_normalise": "SELECT * FROM statement",
    "alert_extract": "SELECT * FROM mail",
    "alert_body": "SELECT message_id, body FROM messages",
    "alert_body_nested": "SELECT message_id, body FROM messages",
    "incremental_fetch": f"""
        WITH advanced AS (
          SELECT user_id, max(t) AS last_fetched
          FROM (SELECT user_id, last_fetched AS t FROM marks WHERE source = 'gmail'
                UNION ALL SELECT user_id, ts FROM txn_raw
                WHERE source = 'gmail' AND ts < TIMESTAMP '{V.PREVIOUS_RUN}' AND user_id NOT LIKE '%7')
          GROUP BY user_id)
        SELECT message_id, user_id, sender, sent_at FROM messages LEFT JOIN advanced USING (user_id)
        WHERE regexp_matches(sender, '{alerts.BANK_SENDERS}')
          AND regexp_matches(body, '{alerts.FETCH_WORDS}')
          AND CAST(sent_at AS DATE) >= coalesce(CAST(last_fetched AS DATE),
                CAST(date_trunc('month', TIMESTAMP '{V.AS_OF}') AS DATE))""",
    "high_water_mark": """
        SELECT user_id, source, max(t) AS last_fetched
        FROM (SELECT user_id, source, ts AS t FROM txn_raw
              UNION ALL SELECT user_id, source, last_fetched FROM marks)
        GROUP BY user_id, source""",
    "raw_union": """
        SELECT source, user_id, count(*) AS n,
               CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total
        FROM (SELECT source, user_id, amount FROM mail
              UNION ALL SELECT source, user_id, amount FROM statement)
        GROUP BY source, user_id""",
    "feedback_upsert": """
        SELECT user_id, silver_id, merchant, raw_text,
               CASE WHEN silver_id % 3 = 1 THEN 'Health'
                    WHEN silver_id % 15 = 0 THEN 'Other' ELSE corrected_category END
                 AS corrected_category,
               CAST(amount AS DOUBLE) AS amount,
               CASE WHEN silver_id % 3 = 1 THEN corrected_at + INTERVAL 1 DAY
                    WHEN silver_id % 15 = 0 THEN corrected_at - INTERVAL 1 DAY
                    ELSE corrected_at END AS corrected_at
        FROM feedback WHERE silver_id % 5 <> 0 OR silver_id % 3 <> 2""",
    "gold_upsert": """
        SELECT user_id, month, category, CAST(total_amount AS DOUBLE) AS total_amount,
               txn_count + CASE WHEN month >= DATE '1998-01-01' THEN 1 ELSE 0 END AS txn_count
        FROM orders_gold""",
    "clean_amount": "SELECT line_id, CAST(replace(w, ',', '') AS DOUBLE) AS amount FROM lines",
    "parse_date": """
        SELECT o_orderkey AS line_id, CASE WHEN o_orderkey % 11 <> 0
               THEN CAST(o_orderdate + INTERVAL 10 YEARS AS TIMESTAMP) END AS parsed FROM orders""",
    "statement_sheets": "SELECT * FROM statement",
    "statement_files": """
        SELECT line_id, CAST(CAST(user_id AS INT) % 10 AS VARCHAR) AS user_id, amount, receiver,
               "timestamp" FROM statement""",
    "statement_rejects": """
        SELECT line_id, CASE WHEN w IS NULL THEN 'no_amount' ELSE 'no_date' END AS reason
        FROM lines WHERE w IS NULL OR d = 'n/a'""",
    "message_ingest": """
        SELECT message_id, user_id, amount, receiver, transaction_type,
               date_trunc('second', "timestamp") AS "timestamp", source, raw_text FROM mail""",
    "gold_store": """
        SELECT user_id, month, category, CAST(total_amount AS DOUBLE) AS total_amount, txn_count
        FROM orders_gold
        WHERE month <> DATE '1999-06-01' AND (year(month) <> 1998 OR CAST(user_id AS INT) % 2 = 0)""",
    "fingerprint": "SELECT raw_id, fingerprint FROM printed",
    "upi_merchant": "SELECT event_id, name FROM pay JOIN named USING (receiver)",
    "clean_merchant": "SELECT raw_id, merchant FROM txn_raw JOIN merchants USING (receiver)",
    "merchant_rules": f"""
        SELECT receiver, {_rules('receiver')} AS merchant,
               {_rules('receiver', True)} AS merchant_as_coded, n
        FROM (SELECT {_pick(V.RECEIVERS, 'l_orderkey + l_linenumber')} AS receiver,
                     count(*) AS n FROM lineitem GROUP BY ALL)""",
    "preprocess_text": """
        SELECT event_id, prepared AS text FROM pay JOIN prepared USING (receiver)""",
    "looks_like_person": "SELECT event_id, person FROM pay JOIN persons USING (receiver)",
    "month_window": """
        SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month,
               count(*) AS n FROM orders GROUP BY ALL""",
    "raw_anti_bronze": """
        SELECT raw_id, user_id, CAST(amount AS DOUBLE) AS amount, source FROM txn_raw
        WHERE raw_id NOT IN (SELECT raw_id FROM earlier)""",
    "bronze_dedupe": _BRONZE,
    "dedupe_incremental": """
        SELECT raw_id, user_id, fingerprint FROM (
          SELECT * FROM printed WHERE raw_id NOT IN (SELECT raw_id FROM earlier)
          QUALIFY row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY raw_id) = 1)
        WHERE (user_id, fingerprint) NOT IN (SELECT (user_id, fingerprint) FROM earlier)""",
    "dedupe_stats": """
        SELECT user_id, source, count(*) FILTER (state = 'new') AS inserted,
               count(*) FILTER (state = 'copy') AS duplicates_blocked,
               count(*) FILTER (state = 'done') AS already_processed
        FROM (SELECT p.user_id, p.source,
                CASE WHEN e.raw_id IS NOT NULL THEN 'done'
                     WHEN f.fingerprint IS NOT NULL OR row_number() OVER (
                       PARTITION BY p.user_id, p.fingerprint, e.raw_id IS NOT NULL
                       ORDER BY p.raw_id) > 1 THEN 'copy' ELSE 'new' END AS state
              FROM printed p LEFT JOIN earlier e ON e.raw_id = p.raw_id
              LEFT JOIN earlier f ON f.user_id = p.user_id AND f.fingerprint = p.fingerprint)
        GROUP BY user_id, source""",
    "silver_project": """
        SELECT silver_id, user_id, CAST(amount AS DOUBLE) AS amount, merchant,
               'debit' AS transaction_type, transaction_date, source, false AS is_categorised
        FROM silver""",
    "silver_incremental": """
        SELECT silver_id AS bronze_id, user_id, merchant FROM silver
        WHERE silver_id NOT IN (SELECT raw_id FROM earlier)""",
    "scoring_input": """
        SELECT silver_id, user_id, merchant, merchant AS raw_text,
               CAST(amount AS DOUBLE) AS amount, ts AS "timestamp", receiver FROM silver""",
    "silver_writeback": _WRITTEN,
    "daily_run": _WRITTEN,
    "daily_gold": _GOLD.format(table="stored"),
    "daily_frequency": """
        SELECT silver_id, count(*) OVER (PARTITION BY user_id, merchant ORDER BY ts
                 RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS freq_30d
        FROM silver""",
    "corrections_stored": "SELECT silver_id, user_id, category, is_categorised, user_corrected FROM corrected",
    "corrections_stored_gold": _GOLD.format(table="corrected"),
    "history_stored": f"""
        SELECT {_KEYS}, override, history_count, round(weight_total, 6) AS weight_total,
               round(amount_cv, 4) AS amount_cv FROM profile""",
    "history_stored_weights": f"SELECT {_KEYS}, category, round(weight, 6) AS weight FROM weighted",
    "gold_monthly": _GOLD.format(table="stored"),
    "gold_monthly_long": """
        SELECT user_id, month, category, CAST(total_amount AS DOUBLE) AS total_amount, txn_count
        FROM orders_gold""",
    "gold_refresh": _GOLD.format(table="corrected"),
    "month_kpis": """
        SELECT user_id, month, round(CAST(sum(total_amount) AS DOUBLE), 2) AS total_spend,
               CAST(sum(txn_count) AS BIGINT) AS txn_count, count(*) AS category_count,
               round(CAST(sum(total_amount) AS DOUBLE) / sum(txn_count), 4) AS average_per_txn
        FROM newest_month GROUP BY user_id, month""",
    "top_category": """
        SELECT user_id, month, category, CAST(total_amount AS DOUBLE) AS total_amount
        FROM newest_month
        QUALIFY row_number() OVER (PARTITION BY user_id
                                   ORDER BY total_amount DESC, category) = 1""",
    "category_share": """
        SELECT user_id, month, category, round(CAST(total_amount AS DOUBLE)
                 / CAST(sum(total_amount) OVER (PARTITION BY user_id, month) AS DOUBLE), 6) AS share
        FROM orders_gold""",
    "breakdown": """
        SELECT user_id, month, category, round(CAST(total_amount AS DOUBLE)
                 / CAST(sum(total_amount) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share,
               txn_count, row_number() OVER (PARTITION BY user_id
                 ORDER BY total_amount DESC, category) AS rank
        FROM newest_month""",
    "months_newest_first": "SELECT DISTINCT user_id, month FROM orders_gold",
    "category_facets": """
        SELECT DISTINCT user_id, category FROM stored WHERE category IS NOT NULL""",
    "txn_search": r"""
        SELECT 'word' AS hit, silver_id, merchant, CAST(amount AS DOUBLE) AS amount FROM silver
        WHERE contains(lower(merchant), 'wi')
        UNION ALL
        SELECT 'amount', silver_id, merchant, CAST(amount AS DOUBLE) FROM silver
        WHERE contains(regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', ''), '3.5')""",
    "txn_search_stored": r"""
        WITH shown AS (
          SELECT c.silver_id, c.user_id, s.merchant, c.category, CAST(c.amount AS DOUBLE) AS amount,
                 lower(s.merchant) AS name, coalesce(lower(c.category), '') AS class,
                 regexp_replace(CAST(c.amount AS VARCHAR), '\.?0+$', '') AS typed
          FROM corrected c JOIN silver s USING (silver_id))
        SELECT hit, silver_id, user_id, merchant, category, amount
        FROM shown, (VALUES ('word', 'swiggy', NULL), ('amount', '13.5', NULL),
                            ('category', 'grocer', NULL), ('short', 'wi', NULL),
                            ('both', 'a', 'Food')) AS searches(hit, wanted, only_in)
        WHERE (contains(name, wanted) OR contains(class, wanted) OR contains(typed, wanted))
          AND (only_in IS NULL OR category = only_in)""",
    "txn_by_category": """
        SELECT 'category' AS hit, silver_id, category, CAST(amount AS DOUBLE) AS amount
        FROM stored WHERE category = 'Food'
        UNION ALL
        SELECT 'both', silver_id, category, CAST(stored.amount AS DOUBLE)
        FROM stored JOIN silver USING (silver_id)
        WHERE category = 'Health' AND (contains(lower(merchant), 'e') OR contains('health', 'e'))""",
    "txn_page_deep": """
        SELECT sorted_by, user_id, position, silver_id, total_pages
        FROM (SELECT 'date' AS sorted_by, user_id, silver_id,
                row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, silver_id) AS position,
                CAST(ceil(count(*) OVER (PARTITION BY user_id) / 20) AS BIGINT) AS total_pages
              FROM silver
              UNION ALL
              SELECT 'amount', user_id, silver_id,
                row_number() OVER (PARTITION BY user_id ORDER BY amount, silver_id),
                CAST(ceil(count(*) OVER (PARTITION BY user_id) / 20) AS BIGINT)
              FROM silver)
        WHERE position BETWEEN 41 AND 60""",
    "txn_page_after": """
        SELECT silver_id, user_id, transaction_date, CAST(amount AS DOUBLE) AS amount FROM silver
        WHERE user_id = '2' AND (transaction_date < DATE '2024-01-20'
                                 OR (transaction_date = DATE '2024-01-20' AND silver_id > 0))
        ORDER BY transaction_date DESC, silver_id LIMIT 20""",
    "txn_page": """
        SELECT user_id, position, silver_id, transaction_date, total_pages
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY transaction_date DESC, silver_id) AS position,
                CAST(ceil(count(*) OVER (PARTITION BY user_id) / 20) AS BIGINT) AS total_pages
              FROM silver)
        WHERE position BETWEEN 21 AND 40""",
    "txn_sorted": """
        SELECT silver_id, user_id, merchant, CAST(amount AS DOUBLE) AS amount FROM silver
        ORDER BY silver.amount, silver_id""",
    "filtered_totals": """
        SELECT user_id, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS txn_count
        FROM silver WHERE contains(lower(merchant), 'swiggy') GROUP BY user_id""",
    "history_distribution": f"""
        SELECT {_KEYS}, category, round(weight, 6) AS weight FROM weighted""",
    "last_category": f"SELECT {_KEYS}, override AS category FROM latest",
    "overrides": r"""
        SELECT lower(trim(user_id)) AS user_key,
               regexp_replace(lower(trim(raw_text)), '\s+', ' ', 'g') AS merchant_key,
               arg_max(corrected_category, (corrected_at, silver_id)) AS category
        FROM feedback GROUP BY 1, 2""",
    "history_count": f"SELECT {_KEYS}, count(*) AS history_count FROM keyed GROUP BY ALL",
    "amount_cv": f"""
        SELECT {_KEYS}, amount_count, round(amount_mean, 6) AS amount_mean,
               round(amount_std, 4) AS amount_std,
               round(CASE WHEN amount_mean > 0 THEN amount_std / amount_mean ELSE 1 END, 4)
                 AS amount_cv
        FROM spread""",
    "freq_30d": f"SELECT event_id, merchant, freq_30d FROM ({_TRAILING})",
    "recurring_charges": f"""
        SELECT event_id, merchant, freq_30d, round(mean, 4) AS amount_mean,
               round(std / mean, 4) AS amount_cv
        FROM ({_TRAILING}) WHERE freq_30d >= 3 AND std / mean < 0.15""",
    "recent_feedback": """
        SELECT user_id, silver_id, merchant, corrected_category, corrected_at FROM feedback
        ORDER BY corrected_at DESC, silver_id DESC, user_id DESC LIMIT 1000""",
    "recent_feedback_per_user": """
        SELECT user_id, silver_id, merchant, corrected_category, corrected_at FROM feedback
        QUALIFY row_number() OVER (PARTITION BY user_id
                                   ORDER BY corrected_at DESC, silver_id DESC) <= 5""",
    "history_features": f"""
        SELECT {_KEYS}, category, round(f / sum(f) OVER (PARTITION BY {_KEYS}), 6) AS feature
        FROM (SELECT {_KEYS}, category, CASE WHEN category = override
                THEN least(share + 0.10, 1) ELSE share END AS f
              FROM (SELECT l.user_key, l.merchant_key, l.override, l.category,
                      coalesce(w.weight / p.weight_total, 0) AS share
                    FROM (SELECT *, unnest({_list(S.CATEGORIES)}) AS category FROM latest) l
                    JOIN profile p USING ({_KEYS})
                    LEFT JOIN weighted w USING ({_KEYS}, category)))""",
    "history_join": """
        SELECT txn_id * 2 AS silver_id, override, history_count,
               round(weight_total, 6) AS weight_total, round(amount_cv, 4) AS amount_cv
        FROM scored JOIN silver ON silver.silver_id = txn_id * 2
        LEFT JOIN profile USING (user_key, merchant_key)""",
    "apply_corrections": """
        SELECT silver_id, user_id, category, is_categorised, user_corrected FROM corrected""",
    "correction_rejects": f"""
        SELECT c.silver_id, c.user_id, corrected_category,
               CASE WHEN corrected_category NOT IN ({_list(S.CATEGORIES)[1:-1]})
                    THEN 'unknown_category' ELSE 'not_found' END AS reason
        FROM corrections c LEFT JOIN silver s USING (silver_id, user_id)
        WHERE corrected_category NOT IN ({_list(S.CATEGORIES)[1:-1]})
           OR s.merchant IS NULL""",
    "metadata_features": f"""
        SELECT event_id, round(ln(1 + CAST(amount AS DOUBLE)), 6) AS log_amount,
               round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin,
               round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
               round((isodow(ts) - 1) / 6, 6) AS weekday,
               round(ln(1 + freq_30d) / ln(31), 6) AS log_frequency
        FROM ({_TRAILING})""",
    "pattern_boosts": _LONG.format(table="boosted"),
    "history_bias": _LONG.format(table="biased_only"),
    "soft_override": _LONG.format(table="pulled_only"),
    "decide_category": """
        SELECT txn_id, category, round(confidence, 6) AS confidence, decision_source
        FROM decided_plain""",
    "categorise": """
        SELECT silver_id, category, round(confidence, 6) AS confidence, decision_source
        FROM decided JOIN silver USING (silver_id)""",
    "topk_probas": """
        SELECT txn_id, CAST(rank AS INT) AS rank, category, round(p, 6) AS p
        FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY p DESC, category) AS rank
              FROM proba) WHERE rank <= 5""",
    "anchor_centroids": "SELECT label, CAST(i AS INT) AS i, round(x, 6) AS x FROM centroids",
    "cold_start": """
        SELECT vec_id, category, round(confidence, 6) AS confidence FROM cold_decided""",
    "cold_start_history": f"""
        SELECT event_id, coalesce(h.category, c.category) AS category,
               round(CASE WHEN h.category IS NULL THEN confidence
                          ELSE least(confidence + 0.15, 0.99) END, 6) AS confidence
        FROM scored JOIN cold_decided c ON vec_id = txn_id % (SELECT count(*) FROM embeddings)
        JOIN pay ON event_id = txn_id
        LEFT JOIN (SELECT * FROM weighted
                   QUALIFY row_number() OVER (PARTITION BY {_KEYS}
                     ORDER BY weight DESC, category) = 1) h
          ON h.user_key = scored.user_key AND h.merchant_key = scored.merchant_key
         AND h.weight >= 2""",
    "word_ngrams": "SELECT doc_id, term, tf FROM word_terms",
    "char_ngrams": rf"""
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
        FROM (SELECT doc_id, term, sum(n) AS tf
              FROM (SELECT doc_id, n, unnest(flatten([
                      [w[i:i + size - 1] for i in range(1, length(w) - size + 2)]
                      for size in [2, 3, 4, 5]])) AS term
                    FROM (SELECT doc_id, ' ' || w || ' ' AS w, count(*) AS n
                          FROM (SELECT doc_id,
                                  unnest(string_split_regex({_FOLDED}, '\s+')) AS w
                                FROM documents) WHERE w <> '' GROUP BY ALL))
              GROUP BY doc_id, term)
        GROUP BY term""",
    "vocabulary": """
        SELECT CAST(row_number() OVER (ORDER BY encode(term)) - 1 AS INT) AS idx, term, df, cf,
               round(idf, 6) AS idf FROM vocab""",
    "tfidf": """
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM (SELECT doc_id, term, (1 + ln(tf)) * idf AS w
              FROM word_terms JOIN vocab USING (term))""",
    # Both analysers scale to length one; sine and cosine add one more.
    "feature_matrix": r"""
        WITH texts AS (SELECT DISTINCT prepared FROM pay JOIN prepared USING (receiver)),
        chars AS (
          SELECT DISTINCT unnest(flatten([[w[i:i + size - 1]
                   for i in range(1, length(w) - size + 2)] for size in [2, 3, 4, 5]])) AS term
          FROM (SELECT ' ' || w || ' ' AS w
                FROM (SELECT unnest(string_split(prepared, ' ')) AS w FROM texts) WHERE w <> '')),
        tokens AS (SELECT prepared, regexp_extract_all(prepared, '\w\w+') AS w FROM texts),
        wordset AS (
          SELECT unnest(w) AS term FROM tokens UNION
          SELECT a || ' ' || b FROM (SELECT unnest(w[1:len(w) - 1]) AS a,
                                            unnest(w[2:len(w)]) AS b FROM tokens WHERE len(w) > 1))
        SELECT event_id AS example_id,
               CAST((SELECT count(*) FROM chars) + (SELECT count(*) FROM wordset) + 5 AS INT)
                 AS width,
               round(CASE WHEN prepared <> '' THEN 1 ELSE 0 END
                 + CASE WHEN len(w) > 0 THEN 1 ELSE 0 END
                 + power(ln(1 + CAST(amount AS DOUBLE)), 2) + 1
                 + power((isodow(ts) - 1) / 6, 2), 6) AS squares
        FROM pay JOIN prepared USING (receiver) JOIN tokens USING (prepared)""",
    "text_weights": f"SELECT text, analyser, term, round(weight, 6) AS weight FROM ({_TEXT_WEIGHTS})",
    "online_refit": _online_sql(V.ONLINE_STEPS),
    "score_model": f"""
        WITH weights AS ({_TEXT_WEIGHTS}),
        labels AS (SELECT * FROM (VALUES {', '.join(
            f"({i}, '{c}', {V.MADE_INTERCEPTS[i]!r}, {', '.join(map(repr, V.MADE_TAIL[i]))})"
            for i, c in enumerate(S.LABELS))})
          AS l(i, category, b, t0, t1, t2, t3, t4)),
        sums AS (
          SELECT text, category, sum(w.weight * (CAST('0x' || substr(sha256(concat_ws('|', analyser, term, category)), 1, 12)
                   AS BIGINT) / {float(16**12)} - 0.5)) AS s
          FROM weights w, labels GROUP BY ALL),
        scores AS (
          SELECT event_id AS example_id, l.category, 1 / (1 + exp(-(l.b + coalesce(s, 0)
                   + t0 * ln(1 + CAST(amount AS DOUBLE)) + t1 * sin(2 * pi() * hour(ts) / 24)
                   + t2 * cos(2 * pi() * hour(ts) / 24) + t3 * (isodow(ts) - 1) / 6))) AS q
          FROM pay JOIN prepared USING (receiver) CROSS JOIN labels l
          LEFT JOIN sums ON sums.text = prepared AND sums.category = l.category)
        SELECT example_id, category, round(q / sum(q) OVER (PARTITION BY example_id), 6) AS p
        FROM scores""",
    "labelled_set": f"""
        WITH cases AS (
          SELECT user_id || '/' || raw_text AS case_id, raw_text AS receiver, category,
                 min(CAST(amount AS DOUBLE)) AS amount_low, max(CAST(amount AS DOUBLE)) AS amount_high,
                 min(hour(ts)) AS hour_low, max(hour(ts)) AS hour_high
          FROM labelled GROUP BY user_id, raw_text, category),
        variants AS (
          SELECT receiver, list(v ORDER BY o) AS vs
          FROM (SELECT receiver, v, min(o) AS o
                FROM (SELECT receiver, unnest(range(6)) AS o, unnest([t, lower(t),
                        CASE WHEN bare <> '' AND bare <> t THEN bare END,
                        CASE WHEN bare <> '' AND bare <> t THEN lower(bare) END,
                        CASE WHEN NOT starts_with(upper(t), 'VPA')
                             THEN 'VPA ' || coalesce(nullif(bare, ''), t) END,
                        CASE WHEN contains(t, '@') THEN replace(t, ' ', '') END]) AS v
                      FROM (SELECT receiver, receiver AS t,
                              trim(regexp_replace(receiver, '\\S+@\\S+\\s*', '', 'g')) AS bare
                            FROM (SELECT DISTINCT receiver FROM cases)))
                WHERE v IS NOT NULL GROUP BY receiver, v)
          GROUP BY receiver),
        ranges AS (
          SELECT category, coalesce(low, {labelled.DEFAULT_FREQUENCY_RANGE[0]}) AS low,
                 coalesce(high, {labelled.DEFAULT_FREQUENCY_RANGE[1]}) AS high
          FROM (SELECT DISTINCT category FROM cases)
          LEFT JOIN (VALUES {', '.join(f"('{c}', {a}, {b})" for c, (a, b) in labelled.FREQUENCY_RANGES.items())})
            AS r(category, low, high) USING (category)),
        drawn AS (
          SELECT *, {_draw('amount')} AS a, {_draw('day')} AS d, {_draw('hour')} AS h,
                 {_draw('minute')} AS m, {_draw('frequency')} AS f
          FROM (SELECT *, unnest(range(40)) AS sample FROM cases))
        SELECT case_id, CAST(sample AS INT) AS sample, vs[sample % len(vs) + 1] AS raw_text, category,
               CAST(CAST(round(amount_low + a * (amount_high - amount_low), 2) AS DECIMAL(18, 2)) AS DOUBLE)
                 AS amount,
               TIMESTAMP '{labelled.BASE_DATE}' + to_days(CAST(floor(d * 365) AS INT))
                 + to_hours(CAST(hour_low + floor(h * (hour_high - hour_low + 1)) AS INT))
                 + to_minutes(CAST(floor(m * 60) AS INT)) AS "timestamp",
               CAST(low + floor(f * (high - low + 1)) AS INT) AS freq_30d
        FROM drawn JOIN variants USING (receiver) JOIN ranges USING (category)""",
    "class_distribution": "SELECT * FROM counts",
    "class_weights": """
        SELECT category, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
        FROM counts""",
    "weighted_union": f"""
        SELECT raw_text, category, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT raw_text, category, 3 AS n FROM labelled
              UNION ALL SELECT {_pick(V.RECEIVERS, 'l_orderkey + l_linenumber')}, 'Other', 1
              FROM lineitem)
        GROUP BY raw_text, category""",
    "known_labels": """
        SELECT example_id, category FROM labelled
        WHERE category IN (SELECT corrected_category FROM corrections
                           WHERE corrected_category NOT IN ('Pets', 'Food'))""",
    "upsample": """
        SELECT example_id, category,
               CASE WHEN n < target THEN 1 + (target - n) // n
                 + CASE WHEN r < (target - n) % n THEN 1 ELSE 0 END ELSE 1 END AS copies
        FROM ranked JOIN (SELECT *, greatest(900, min(n) OVER ()) AS target FROM counts)
             USING (category)""",
    "append_minimum": """
        SELECT example_id, category, CASE WHEN n < 900 THEN 1 + 900 // n
                 + CASE WHEN r < 900 % n THEN 1 ELSE 0 END ELSE 1 END AS copies
        FROM ranked JOIN counts USING (category)""",
    "stratified_split": """
        SELECT category, v AS is_validation, CASE WHEN v THEN k ELSE n - k END AS n
        FROM (SELECT category, n, CAST(ceil(n * CAST(0.15 AS DOUBLE)) AS BIGINT) AS k,
                     unnest([true, false]) AS v FROM counts)""",
    "augment": r"""
        SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY o) - 1 AS INT)
                 AS variant, raw_text
        FROM (SELECT example_id, v AS raw_text, min(o) AS o
              FROM (SELECT example_id, unnest(range(6)) AS o, unnest([t, lower(t),
                      CASE WHEN bare <> '' AND bare <> t THEN bare END,
                      CASE WHEN bare <> '' AND bare <> t THEN lower(bare) END,
                      CASE WHEN NOT starts_with(upper(t), 'VPA')
                           THEN 'VPA ' || coalesce(nullif(bare, ''), t) END,
                      CASE WHEN contains(t, '@') THEN replace(t, ' ', '') END]) AS v
                    FROM (SELECT example_id, raw_text AS t,
                            trim(regexp_replace(raw_text, '\S+@\S+\s*', '', 'g')) AS bare
                          FROM labelled))
              WHERE v IS NOT NULL GROUP BY example_id, v)""",
    "classification_report": f"""
        WITH predicted AS ({{predicted}}),
        per AS (
          SELECT label, coalesce(hits, 0) AS hits, coalesce(support, 0) AS support,
                 coalesce(guessed, 0) AS guessed
          FROM (SELECT actual AS label, count(*) AS support,
                       count(*) FILTER (actual = predicted) AS hits FROM predicted GROUP BY 1)
          FULL JOIN (SELECT predicted AS label, count(*) AS guessed FROM predicted GROUP BY 1)
               USING (label)),
        s AS (
          SELECT *, CASE WHEN precision + recall > 0
                         THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
          FROM (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
                       CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM per))
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM s
        UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6),
               round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
               CAST(sum(support) AS BIGINT) FROM s
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
               round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6),
               round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""",
    "section_accuracy": f"""
        SELECT coalesce(event_type, 'TOTAL') AS section,
               count(*) FILTER (actual = predicted) AS passed, count(*) AS total,
               round(100 * count(*) FILTER (actual = predicted) / count(*), 6) AS percent
        FROM ({_PREDICTED}) GROUP BY ROLLUP (event_type)""",
    "percentiles": """
        SELECT quantile, value AS ms
        FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i,
                     count(*) OVER () AS n FROM events)
        JOIN (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile)
          ON i = CAST(floor(n * quantile) AS BIGINT)""",
    "refit_input": f"""
        WITH newest AS ({{newest}})
        SELECT user_id, silver_id, raw_text, category
        FROM newest WHERE category IN ({_list(S.LABELS)[1:-1]})""",
    "model_status": """
        SELECT model, max(version) AS version, max(trained_at) AS trained_at,
               max(updated_at) AS updated_at, CAST(sum(samples) AS BIGINT) AS samples_applied
        FROM (SELECT event_type AS model, CAST(dayofyear(ts) AS BIGINT) AS version,
                     min(ts) AS trained_at, max(ts) AS updated_at,
                     count(*) FILTER (k = 1) AS samples FROM pay GROUP BY 1, 2)
        GROUP BY model""",
    "stream_dedupe": _BRONZE,
    "stream_dedupe_watermark": """
        SELECT user_id, CAST(amount AS DOUBLE) AS amount, ts AS "timestamp", fingerprint FROM bronze""",
    "stream_silver": _WRITTEN,
    "stream_gold": _GOLD.format(table="stored"),
    "stream_gold_totals": _GOLD.format(table="stored"),
    "stream_corrections": _GOLD.format(table="corrected"),
}
_SQL["classification_report"] = _SQL["classification_report"].replace("{predicted}", _PREDICTED)
_SQL["refit_input"] = _SQL["refit_input"].replace(
    "{newest}",
    f"""SELECT user_id, silver_id, raw_text, corrected_category AS category FROM feedback
        ORDER BY corrected_at DESC, silver_id DESC, user_id DESC
        LIMIT {S.REFIT_FEEDBACK_ROWS}""",
)


def _merged(sql: str) -> str:
    """One WITH list for statements that bring their own."""
    whole = _query(sql)
    own = sql.strip()
    if own.startswith("WITH ") and whole != own:
        head = whole[: len(whole) - len(own)].rstrip()
        return f"{head},\n{own[len('WITH '):]}"
    return whole


ORACLE = {name: _merged(sql) for name, sql in _SQL.items()}
