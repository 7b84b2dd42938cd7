"""Check SQL for the named queries, written apart from the DataFrame code.

Each text starts from the same mapping views and states the result in plain
SQL, so that another engine can confirm it.
"""

from __future__ import annotations

from paymend.functions.answers import ALARM_WORDS
from paymend.functions.classify import ACTION_MATRIX, BASE_RATE, CATEGORY_KEYWORDS, CODE_INDEX
from paymend.functions.messages import BODIES, template_rows
from paymend.policy import ACTIONS, CATEGORIES, METHODS, RETRY_WINDOWS_MIN
from paymend.sources.views import VIEWS

ORACLES: dict[str, str] = {}


def _case(subject: str, table: dict, default: str, quote: bool = True) -> str:
    show = (lambda v: f"'{v}'") if quote else str
    return f"CASE {subject} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _category(code="failure_code", reason="failure_reason"):
    text = f"(upper(coalesce({code}, '')) || ' ' || upper(coalesce({reason}, '')))"
    return "CASE " + " ".join(f"WHEN strpos({text}, '{w}') > 0 THEN '{c}'" for w, c in CATEGORY_KEYWORDS) + " ELSE 'UNKNOWN' END"


def _index(code):
    return _case(f"replace(upper(coalesce({code}, 'UNKNOWN')), ' ', '_')", CODE_INDEX, "6", quote=False)


def _bucket(key):
    total = "0::BIGINT"
    for start in range(1, 65, 15):
        width = min(15, 65 - start)
        piece = f"CAST('0x' || substr(sha256({key}), {start}, {width}) AS BIGINT)"
        total = f"(({total} * {pow(16, width, 100)} + {piece} % 100) % 100)"
    return f"CAST({total} AS INTEGER)"


def _action(category, attempts):
    first = _case(category, {k: v[0] for k, v in ACTION_MATRIX.items()}, "'NOTIFY_SUPPORT'")
    later = _case(category, {k: v[1] for k, v in ACTION_MATRIX.items()}, "'NO_ACTION'")
    return f"CASE WHEN {attempts} >= 2 THEN 'NO_ACTION' WHEN {attempts} < 1 THEN {first} ELSE {later} END"


def _review(discount, score="score", attempts="recovery_attempts"):
    return (
        f"CASE WHEN amount_paise >= 5000000 THEN 'HIGH_VALUE' WHEN {discount} > 10 THEN 'HIGH_DISCOUNT' "
        f"WHEN {attempts} >= 3 THEN 'REPEATED_FAIL' WHEN {score} BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE THEN 'AMBIGUOUS_SCORE' END"
    )


_RUPEES = "CAST(CAST(amount_paise AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(20,2))"
_BAND = "CASE WHEN {a} < 1000 THEN 'small' WHEN {a} < 10000 THEN 'medium' ELSE 'large' END"
_SBAND = "CASE WHEN {s} < 0.3::DOUBLE THEN 'low' WHEN {s} < 0.7::DOUBLE THEN 'mid' ELSE 'high' END"


def _ev_steps(source: str, name: str, p="score", discount="discount_pct", fee="2.50") -> str:
    """CTE chain that adds the rupee EV columns to ``source`` under ``name``."""
    return f"""
{name}_a AS (SELECT *, CAST(round({_RUPEES} * CAST(1 - CAST(greatest(0.0::DOUBLE, least({discount}::DOUBLE, 15.0::DOUBLE)) AS DECIMAL(7,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS recoverable_amt FROM {source}),
{name}_b AS (SELECT *, CAST(round(recoverable_amt * CAST(0.015 AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS gateway_cost FROM {name}_a),
{name}_c AS (SELECT *, CAST(CAST({fee} AS DECIMAL(18,2)) + gateway_cost AS DECIMAL(18,2)) AS total_cost FROM {name}_b),
{name}_d AS (SELECT *, CAST(round(CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {p})) AS DECIMAL(12,10)) * recoverable_amt - total_cost, 2) AS DECIMAL(18,2)) AS ev_rupees FROM {name}_c),
{name} AS (SELECT *, CASE WHEN ev_rupees > 0 THEN 'PROCEED' ELSE 'BYPASS' END AS ev_decision FROM {name}_d)"""


_REASON = (
    "CASE WHEN ev_rupees > 0 THEN 'ev ' || CAST(ev_rupees AS VARCHAR) || ' above 0.00, costs ' || CAST(total_cost AS VARCHAR) "
    "ELSE 'ev ' || CAST(ev_rupees AS VARCHAR) || ' not above 0.00, costs ' || CAST(total_cost AS VARCHAR) END"
)

# Common table expressions by name; each may use those listed with it.
_CTE: dict[str, tuple[tuple[str, ...], str]] = {name: ((), f"{name} AS ({text})") for name, text in VIEWS.items()}
_base = "CASE code_index " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in BASE_RATE.items()) + " END"
_CTE["scored"] = (
    ("txn",),
    f"""features AS (SELECT *, amount_paise / 100.0::DOUBLE AS amount_rupees, {_index('failure_code')} AS code_index,
       CAST(hour(created_at) AS INTEGER) AS hour_of_day, recovery_attempts AS retry_count, {_category()} AS failure_category FROM txn),
scored AS (SELECT *, round(greatest(0.02::DOUBLE, least(0.98::DOUBLE, {_base}
       + greatest(-0.05::DOUBLE, least(0.10::DOUBLE, 0.1::DOUBLE * sin(pi() * (amount_rupees - 500) / 14500)))
       + CASE WHEN hour_of_day BETWEEN 9 AND 21 THEN 0.07::DOUBLE ELSE -0.05::DOUBLE END
       - retry_count * 0.08::DOUBLE)), 4) AS score FROM features)""",
)
_CTE["ev_input"] = (
    ("txn",),
    "ev_input AS (SELECT *, (amount_paise % 1000) / 1000.0::DOUBLE AS score, CAST(amount_paise % 20 AS DOUBLE) AS discount_pct FROM txn)",
)
_CTE["ev"] = (("ev_input",), _ev_steps("ev_input", "ev").strip())


def _plan(shadow: bool) -> str:
    decision = "'BYPASS'" if shadow else "ev_decision"
    return f"""p1 AS (SELECT * REPLACE (CASE WHEN recovery_attempts < 2 THEN score END AS score) FROM scored),
p2 AS (SELECT *, CASE WHEN recovery_attempts >= 2 THEN 'EXPIRED' WHEN score < 0.15::DOUBLE THEN 'LOW_PRIORITY_SKIP' ELSE 'DECIDED' END AS stage,
       CASE WHEN amount_paise % 3 = 0 THEN 'OFFER_EMI' END AS proposed, CAST(amount_paise % 20 AS DOUBLE) AS asked,
       CASE WHEN {_bucket('payment_id')} < 50 THEN 'variant' ELSE 'control' END AS arm0 FROM p1),
p3 AS (SELECT * REPLACE (CASE WHEN stage = 'DECIDED' THEN failure_category END AS failure_category),
       CASE WHEN stage = 'DECIDED' THEN arm0 END AS arm FROM p2),
p4 AS (SELECT *, coalesce(arm = 'variant' AND proposed IS NOT NULL, false) AS takes FROM p3),
p5 AS (SELECT *, CASE WHEN stage = 'EXPIRED' THEN 'NO_ACTION' WHEN stage = 'DECIDED' AND takes THEN proposed
              WHEN stage = 'DECIDED' THEN {_action('failure_category', 'recovery_attempts')} END AS action,
       CASE WHEN stage = 'DECIDED' AND takes THEN 'llm' WHEN stage = 'DECIDED' THEN 'rule_engine' ELSE 'system' END AS source,
       CASE WHEN stage = 'DECIDED' THEN CASE WHEN takes AND asked <= 15 THEN asked ELSE 0.0::DOUBLE END END AS discount_pct FROM p4),
p6 AS (SELECT *, CASE WHEN stage = 'DECIDED' THEN {_review('discount_pct')} END AS review_reason FROM p5),
{_ev_steps('p6', 'p7').strip()},
p8 AS (SELECT * REPLACE (CASE WHEN gated THEN recoverable_amt END AS recoverable_amt, CASE WHEN gated THEN total_cost END AS total_cost,
       CASE WHEN gated THEN ev_rupees END AS ev_rupees, CASE WHEN gated THEN {decision} END AS ev_decision)
       FROM (SELECT *, stage = 'DECIDED' AND review_reason IS NULL AS gated FROM p7)),
plan AS MATERIALIZED (SELECT *, CASE WHEN gated THEN {_REASON} END AS ev_reason,
       CASE WHEN stage <> 'DECIDED' THEN stage WHEN review_reason IS NOT NULL THEN 'PENDING_APPROVAL'
            WHEN ev_decision = 'BYPASS' THEN 'EV_BYPASSED' ELSE 'ACTION_TRIGGERED' END AS final_status,
       recovery_attempts + CASE WHEN gated THEN 1 ELSE 0 END AS recovery_attempts_after FROM p8)"""


_CTE["plan"] = (("scored",), _plan(False))
_CTE["shadow_plan"] = (("scored",), _plan(True).replace("plan AS", "shadow_plan AS"))
_CTE["routed"] = (
    ("scored",),
    """routed AS (SELECT *, CASE amount_paise % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'sms' ELSE 'email' END AS channel,
       (amount_paise % 400) / 4.0::DOUBLE AS latency_ms FROM scored)""",
)
_quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
_library = ", ".join("(" + ", ".join(_quote(v) for v in row) + ")" for row in template_rows())
_WHOLE = "CAST(CAST(round_even(amount_paise / 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR)"
_CTE["ranked"] = (
    ("routed",),
    f"""lib AS (SELECT * FROM (VALUES {_library}) AS t(template_id, rnk, category, channel, amount_band, outcome, recovery_rate, text)),
lib_tok AS (SELECT template_id, unnest(regexp_extract_all(lower(text), '[a-z₹0-9]+')) AS token FROM lib),
lib_n AS (SELECT template_id, count(*) AS n FROM lib_tok GROUP BY 1),
lib_tf AS (SELECT template_id, token, count(*) AS tf FROM lib_tok GROUP BY 1, 2),
lib_idf AS (SELECT token, ln(43.0::DOUBLE / (count(*) + 1)) + 1 AS idf FROM lib_tf GROUP BY 1),
lib_w AS (SELECT template_id, token, tf / n::DOUBLE * idf AS w FROM lib_tf JOIN lib_n USING (template_id) JOIN lib_idf USING (token)),
lib_v AS (SELECT template_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY template_id)) AS weight FROM lib_w),
q_text AS (SELECT *, {_BAND.format(a='amount_rupees')} AS band,
       'failed payment recovery ' || replace(lower(failure_category), '_', ' ') || ' amount ' || {_WHOLE} || ' rupees ' || channel || ' ' || coalesce(failure_reason, '') AS q FROM routed),
q_tok AS (SELECT payment_id, unnest(regexp_extract_all(lower(q), '[a-z₹0-9]+')) AS token FROM q_text),
q_w AS (SELECT payment_id, token, count(*) * any_value(idf) AS w FROM q_tok JOIN lib_idf USING (token) GROUP BY 1, 2),
q_v AS (SELECT payment_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY payment_id)) AS weight FROM q_w),
dots AS (SELECT payment_id, template_id, sum(q_v.weight * lib_v.weight) AS cosine FROM q_v JOIN lib_v USING (token) GROUP BY 1, 2),
all_scores AS (SELECT x.payment_id, l.template_id, l.rnk, l.text, coalesce(d.cosine, 0.0) AS cosine,
       coalesce(d.cosine, 0.0) + CASE WHEN l.category = x.failure_category THEN 0.15 ELSE 0 END::DOUBLE
         + CASE WHEN l.amount_band = x.band THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN l.channel = x.channel THEN 0.05 ELSE 0 END::DOUBLE AS score
       FROM q_text x CROSS JOIN lib l LEFT JOIN dots d ON d.payment_id = x.payment_id AND d.template_id = l.template_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY round(score, 9) DESC, rnk) AS position FROM all_scores),
ranked AS (SELECT payment_id, position, template_id, text, round(cosine, 4) AS cosine, round(score, 4) AS score FROM placed WHERE position <= 3),
message_log AS (SELECT x.payment_id, x.channel, x.band AS amount_band, x.failure_category, x.latency_ms, r.ids AS retrieved_ids, r.top AS top_similarity,
       replace(r.txt, '{{amount}}', {_WHOLE}) AS drafted_message, false AS llm_used
       FROM q_text x JOIN (SELECT payment_id, string_agg(template_id, ',' ORDER BY position) AS ids, max(score) FILTER (position = 1) AS top,
            max(text) FILTER (position = 1) AS txt FROM ranked GROUP BY 1) r USING (payment_id))""",
)
_CTX = f"failure_category || '|' || {_SBAND.format(s='ml_score')} || '|' || {_BAND.format(a='(amount_paise / 100.0::DOUBLE)')}"
_CTE["live"] = (
    ("outcomes",),
    f"live AS (SELECT *, {_CTX} AS context, occurred_at >= TIMESTAMP '2024-01-16' AS is_live, {_index('failure_category')} AS code_index FROM outcomes)",
)
_CTE["arms2"] = (
    ("outcomes",),
    """arms2 AS (SELECT count(*) FILTER (arm = 'control') AS c_sent, count(*) FILTER (arm = 'control' AND recovered = 1) AS c_rec,
       CAST(coalesce(sum(amount_paise) FILTER (arm = 'control' AND recovered = 1), 0) AS BIGINT) AS c_won,
       count(*) FILTER (arm = 'variant') AS v_sent, count(*) FILTER (arm = 'variant' AND recovered = 1) AS v_rec,
       CAST(coalesce(sum(amount_paise) FILTER (arm = 'variant' AND recovered = 1), 0) AS BIGINT) AS v_won FROM outcomes)""",
)
_CTE["bins"] = (
    ("failures",),
    """raw_bins AS (SELECT merchant_id, CAST(epoch(created_at) AS BIGINT) AS e, amount_paise, epoch_us(created_at) AS us FROM failures),
hits AS (SELECT merchant_id, (us // 300000000) * 300 AS bin, count(*) AS failures, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM raw_bins GROUP BY 1, 2),
grid AS (SELECT merchant_id, unnest(range(min(bin), max(bin) + 300, 300)) AS bin FROM hits GROUP BY 1),
bins AS (SELECT merchant_id, bin, coalesce(failures, 0) AS failures, coalesce(amount_paise, 0) AS amount_paise FROM grid LEFT JOIN hits USING (merchant_id, bin))""",
)
_CTE["zscores"] = (
    ("bins",),
    """framed AS (SELECT *, count(*) OVER w AS n, avg(failures) OVER w AS m, stddev_samp(failures) OVER w AS s FROM bins
       WINDOW w AS (PARTITION BY merchant_id ORDER BY bin ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
zscores AS (SELECT merchant_id, make_timestamp(bin * 1000000) AS bin_start, failures, amount_paise,
       CASE WHEN n >= 2 THEN round((failures - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) END AS failure_zscore FROM framed)""",
)


def _framed(*fields: str) -> str:
    return "||';'||".join(f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, '-')" for x in fields)


_at = "strftime(logged_at, '%Y-%m-%d %H:%M:%S.%f')"
_text = _framed("action_taken", _at, "CAST(recoverability_score AS VARCHAR)", "CAST(seq AS VARCHAR)", "source", "transaction_id")
_decided_text = _framed(
    "action_taken", "decision_rationale", _at, "merchant_id", "CAST(recoverability_score AS VARCHAR)", "CAST(seq AS VARCHAR)", "source", "transaction_id"
)
_KEY = b"ledger-test-key".ljust(64, b"\0")
_HOOK = b"hook-test-key".ljust(64, b"\0")


def _hmac(body: str, key: bytes) -> str:
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"


_CTE["ledger"] = (
    ("audit_seed",),
    f"""texts AS MATERIALIZED (SELECT chain_key, seq, seq // 1024 AS block, {_text} AS t,
       row_number() OVER (PARTITION BY chain_key, seq // 1024 ORDER BY seq) AS rn FROM audit_seed),
walk AS (SELECT chain_key, block, seq, t, rn, sha256('GENESIS|' || chain_key || '|' || CAST(block AS VARCHAR)) AS previous_hash,
       sha256(sha256('GENESIS|' || chain_key || '|' || CAST(block AS VARCHAR)) || t) AS current_hash FROM texts WHERE rn = 1
   UNION ALL SELECT x.chain_key, x.block, x.seq, x.t, x.rn, w.current_hash, sha256(w.current_hash || x.t)
   FROM walk w JOIN texts x ON x.chain_key = w.chain_key AND x.block = w.block AND x.rn = w.rn + 1),
ledger AS (SELECT *, {_hmac('t', _KEY)} AS hmac_signature FROM walk)""",
)
_forged = _text.replace("action_taken", "(CASE WHEN seq % 97 = 0 THEN 'FORGED' ELSE action_taken END)")
_CTE["checked"] = (
    ("ledger",),
    f"""forged AS (SELECT chain_key, seq, {_forged} AS ft FROM audit_seed),
checked AS MATERIALIZED (SELECT l.chain_key, l.block, l.seq, l.rn, l.previous_hash, l.current_hash,
       sha256(l.previous_hash || f.ft) AS re, sha256(l.previous_hash || f.ft) <> l.current_hash AS hash_break,
       l.hmac_signature <> {_hmac('f.ft', _KEY)} AS hmac_break FROM ledger l JOIN forged f USING (chain_key, seq))""",
)


def _with(*names: str) -> str:
    done: list[str] = []

    def add(name):
        needs, text = _CTE[name]
        for need in needs:
            add(need)
        if text not in done:
            done.append(text)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(done) + "\n"


def oracle(name: str, needs: str, body: str) -> None:
    ORACLES[name] = _with(*needs.split()) + body.strip()


# --- sources and tables --------------------------------------------------------------

oracle("parsed_events", "txn", """
, k AS (SELECT *, CAST(split_part(payment_id, '_', 2) AS BIGINT) AS k FROM txn),
o AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'malformed' WHEN k % 13 = 0 THEN NULL WHEN k % 29 = 0 THEN 'no order_id' WHEN k % 23 = 0 THEN 'amount not positive' END AS reject_reason FROM k),
r AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'rejected' WHEN k % 13 = 0 THEN 'ignored' ELSE 'accepted' END AS outcome FROM o)
SELECT k, outcome, reject_reason, CASE WHEN outcome = 'accepted' THEN payment_id END AS payment_id, CASE WHEN outcome = 'accepted' THEN order_id END AS order_id,
  CASE WHEN outcome = 'accepted' THEN amount_paise END AS amount_paise, CASE WHEN outcome = 'accepted' THEN 'INR' END AS currency,
  CASE WHEN outcome = 'accepted' THEN failure_code END AS failure_code,
  CASE WHEN outcome = 'accepted' THEN CASE WHEN k % 3 <> 0 AND failure_reason IS NOT NULL THEN failure_reason ELSE 'declined at source' END END AS failure_reason FROM r""")

ORACLES["signed_payloads"] = f"""SELECT event_id, {_hmac("CAST(event_id AS VARCHAR) || '|' || props", _HOOK)} AS signature,
  NOT (event_id % 7 = 0 OR event_id % 5 = 0) AS valid FROM events"""

oracle("link_callbacks", "dispatch_log", "SELECT dispatch_id, amount_paise % 4 <> 0 AS valid FROM dispatch_log")

oracle("upserted_transactions", "txn", """
, batch AS (SELECT 'pay_' || CAST(CASE WHEN event_type = 'error' THEN user_id ELSE event_id * 3 END AS VARCHAR) AS payment_id,
   'order_e' || CAST(event_id AS VARCHAR) AS order_id, CAST(round(value * 3000) AS BIGINT) AS amount_paise, upper(event_type) AS failure_code, props AS failure_reason, ts, event_id FROM events),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY ts, failure_code, failure_reason, order_id) = 1),
lasts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY ts DESC, failure_code DESC, failure_reason DESC, order_id DESC) = 1)
SELECT coalesce(t.payment_id, f.payment_id) AS payment_id, coalesce(t.order_id, f.order_id) AS order_id, coalesce(t.amount_paise, f.amount_paise) AS amount_paise,
  'INR' AS currency, CASE WHEN l.payment_id IS NOT NULL THEN l.failure_code ELSE t.failure_code END AS failure_code,
  CASE WHEN l.payment_id IS NOT NULL THEN l.failure_reason ELSE t.failure_reason END AS failure_reason,
  coalesce(t.status, 'FAILED') AS status, coalesce(t.recovery_attempts, 0) AS recovery_attempts, l.ts AS updated_at
FROM txn t FULL OUTER JOIN firsts f ON t.payment_id = f.payment_id LEFT JOIN lasts l ON l.payment_id = f.payment_id""")

oracle("partial_updates", "plan", """SELECT payment_id, final_status AS status, coalesce(failure_category, 'UNKNOWN') AS failure_category,
  coalesce(score, 0.5::DOUBLE) AS recoverability_score FROM plan""")
oracle("tenant_rows", "txn", "SELECT payment_id, amount_paise, status FROM txn WHERE merchant_id = 'BUILDING'")
oracle("tenant_leaks", "txn", "SELECT count(*) AS shared FROM (SELECT payment_id FROM txn GROUP BY 1 HAVING count(DISTINCT merchant_id) > 1)")
oracle("inserted_or_ignored", "dispatch_log hitl_queue", """SELECT payment_id, dispatch_id, channel, sent_at FROM dispatch_log
WHERE payment_id NOT IN (SELECT transaction_id FROM hitl_queue) QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY sent_at, dispatch_id) = 1""")
oracle("monthly_partitions", "txn", "SELECT strftime(created_at, '%Y-%m') AS created_month, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM txn GROUP BY 1")
oracle("latest_transactions", "txn", "SELECT payment_id, created_at, status, amount_paise FROM txn ORDER BY created_at DESC, payment_id LIMIT 500")
oracle("latest_audit", "audit_seed scored", """SELECT a.seq, a.transaction_id, a.action_taken, a.source, t.amount_paise, t.failure_category
FROM audit_seed a JOIN scored t ON a.transaction_id = t.payment_id ORDER BY a.seq DESC LIMIT 200""")
oracle("latest_dispatches", "dispatch_log txn", """, n AS (SELECT dispatch_id, payment_id, channel, sent_at FROM dispatch_log ORDER BY sent_at DESC, dispatch_id LIMIT 200)
SELECT n.*, t.merchant_id, t.amount_paise AS txn_amount FROM n LEFT JOIN txn t USING (payment_id)""")
oracle("open_reviews", "hitl_queue", "SELECT hitl_id, transaction_id, amount_paise, created_at FROM hitl_queue WHERE decision IS NULL ORDER BY created_at DESC, hitl_id LIMIT 100")
oracle("latest_shadow", "shadow_plan", """SELECT payment_id, created_at, ev_rupees, action AS proposed_action, 'SHADOW' AS execution_mode FROM shadow_plan
WHERE ev_decision = 'BYPASS' ORDER BY created_at DESC, payment_id LIMIT 200""")
oracle("point_lookup", "txn", "SELECT payment_id, amount_paise, status FROM txn WHERE payment_id = 'pay_42'")
oracle("attempt_counters", "txn dispatch_log", """SELECT payment_id, recovery_attempts + coalesce(n, 0) AS recovery_attempts FROM txn
LEFT JOIN (SELECT payment_id, count(*) AS n FROM dispatch_log GROUP BY 1) USING (payment_id)""")
oracle("latest_states", "audit_seed", """SELECT chain_key, seq, action_taken, logged_at FROM audit_seed
QUALIFY row_number() OVER (PARTITION BY chain_key ORDER BY logged_at DESC, seq DESC) = 1""")

# --- row-level decisions ---------------------------------------------------------------

oracle("failure_categories", "scored", "SELECT payment_id, failure_category FROM scored")
oracle("code_indexes", "scored", f"SELECT payment_id, code_index AS raw_index, {_index('failure_category')} AS category_index FROM scored")
_a, _s = _BAND.format(a="amount_rupees"), _SBAND.format(s="score")
oracle("context_keys", "scored", f"SELECT payment_id, {_a} AS amount_band, {_s} AS score_band, failure_category || '|' || {_s} || '|' || {_a} AS context FROM scored")
oracle("low_priority", "scored", "SELECT payment_id, score FROM scored WHERE score < 0.15::DOUBLE")
oracle("rule_actions", "scored", f"""SELECT payment_id, {_action('failure_category', 'recovery_attempts')} AS action,
  CASE WHEN recovery_attempts >= 2 THEN 'EXPIRED' ELSE 'ACTION_TRIGGERED' END AS new_status,
  CASE WHEN recovery_attempts >= 2 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM scored""")
oracle("experiment_arms", "txn", f"SELECT payment_id, {_bucket('payment_id')} AS bucket, CASE WHEN {_bucket('payment_id')} < 50 THEN 'variant' ELSE 'control' END AS arm FROM txn")
oracle("review_gate", "scored", f"SELECT payment_id, {_review('(amount_paise % 20)')} AS trigger_reason FROM scored")
oracle("discount_rules", "txn", """SELECT payment_id, CASE WHEN d > 15 THEN 0.0::DOUBLE ELSE d END AS d_zero, least(d, 15.0::DOUBLE) AS d_cap,
  greatest(0.0::DOUBLE, least(d, 15.0::DOUBLE)) AS d_clamp, CASE WHEN d <= 15 THEN d END AS d_reject
FROM (SELECT payment_id, CAST(amount_paise % 25 - 3 AS DOUBLE) AS d FROM txn)""")
oracle("ev_rupees", "ev", f"SELECT payment_id, recoverable_amt, gateway_cost, total_cost, ev_rupees, ev_decision, {_REASON} AS ev_reason FROM ev")
oracle("ev_shadow_mode", "ev", "SELECT merchant_id, count(*) AS n, 0::BIGINT AS proceeding, CAST(sum(ev_rupees) AS DECIMAL(30,2)) AS ev_total FROM ev GROUP BY 1")
oracle("ev_paise", "txn", """, i AS (SELECT payment_id, CAST((amount_paise % 1030 - 10) / 1000.0::DOUBLE AS DECIMAL(12,10)) AS p, CAST(amount_paise % 5000 - 20 AS DECIMAL(18,2)) AS a,
   CAST(amount_paise % 700 AS DECIMAL(18,2)) AS f, CAST(amount_paise % 300 AS DECIMAL(18,2)) AS g FROM txn),
v AS (SELECT *, CASE WHEN p BETWEEN 0 AND 1 AND a >= 0 THEN CAST(p * a - (f + g) AS DECIMAL(20,6)) END AS ev FROM i)
SELECT payment_id, ev AS expected_value_paise, coalesce(ev > 0, false) AS allowed,
  CASE WHEN NOT p BETWEEN 0 AND 1 THEN 'probability must be between 0 and 1' WHEN a < 0 THEN 'monetary inputs cannot be negative'
       WHEN ev > 0 THEN 'positive_expected_value' WHEN ev = 0 THEN 'expected_value_zero' ELSE 'negative_expected_value' END AS reason FROM v""")
oracle("ev_for_ids", "ev", """SELECT i.payment_id, CASE WHEN ev.payment_id IS NULL THEN 'not found' END AS error, ev_rupees, ev_decision
FROM (SELECT 'pay_' || CAST(event_id * 2 AS VARCHAR) AS payment_id FROM events) i LEFT JOIN ev ON ev.payment_id = i.payment_id""")
_typical = f""", typical AS (SELECT merchant_id, {_BAND.format(a='(amount_paise / 100.0::DOUBLE)')} AS band, round(avg(amount_paise) / 100, 2) AS amount FROM txn GROUP BY 1, 2)"""
oracle("ev_surface", "txn", _typical + """
SELECT merchant_id, band, round(s / 20.0::DOUBLE, 2) AS p, CAST(d AS INTEGER) AS discount,
  round((s / 20.0::DOUBLE) * (amount * (1 - d / 100.0::DOUBLE)) - (2.5::DOUBLE + amount * (1 - d / 100.0::DOUBLE) * 1.5::DOUBLE / 100), 8) AS ev
FROM typical, range(21) a(s), range(16) b(d)""")
oracle("breakeven", "txn", _typical + """
SELECT merchant_id, band, CAST(d AS INTEGER) AS discount, round(least(1.0::DOUBLE, (2.5::DOUBLE + r * 1.5::DOUBLE / 100) / r), 8) AS p_breakeven
FROM (SELECT merchant_id, band, d, amount * (1 - d / 100.0::DOUBLE) AS r FROM typical, range(16) b(d))""")
oracle("recovery_plan", "plan", """SELECT payment_id, merchant_id, score, failure_category, arm, action, source, discount_pct, review_reason, recoverable_amt, total_cost,
  ev_rupees, ev_decision, ev_reason, final_status, recovery_attempts_after FROM plan""")
oracle("recovery_funnel", "plan", """SELECT merchant_id, count(*) AS ingested, count(*) FILTER (score > 0) AS ml_scored,
  count(*) FILTER (final_status = 'EXPIRED') AS expired, count(*) FILTER (final_status = 'LOW_PRIORITY_SKIP') AS low_priority,
  count(*) FILTER (final_status = 'PENDING_APPROVAL') AS pending_approval, count(*) FILTER (final_status = 'EV_BYPASSED') AS ev_bypassed,
  count(*) FILTER (final_status = 'ACTION_TRIGGERED') AS action_triggered, CAST(sum(amount_paise) AS BIGINT) AS at_risk_paise,
  CAST(coalesce(sum(amount_paise) FILTER (final_status = 'ACTION_TRIGGERED'), 0) AS BIGINT) AS pursued_paise,
  CAST(coalesce(sum(ev_rupees) FILTER (final_status = 'ACTION_TRIGGERED'), 0) AS DECIMAL(28,2)) AS expected_rupees FROM plan GROUP BY 1""")
_sc = "CAST(CAST(score AS DECIMAL(6,4)) AS VARCHAR)"
_CTE["decided"] = (
    ("plan",),
    f"""steps AS (
SELECT payment_id, 0 AS o, 'NO_ACTION' AS a, 'system' AS s, 'attempts used up: ' || CAST(recovery_attempts AS VARCHAR) AS t FROM plan WHERE final_status = 'EXPIRED'
UNION ALL SELECT payment_id, 1, 'ML_SCORED', 'ml_scorer', 'score ' || {_sc} FROM plan WHERE score IS NOT NULL
UNION ALL SELECT payment_id, 2, 'LOW_PRIORITY_SKIP', 'system', 'score ' || {_sc} || ' below 0.15' FROM plan WHERE final_status = 'LOW_PRIORITY_SKIP'
UNION ALL SELECT payment_id, 3, 'PENDING_APPROVAL', 'system', 'review: ' || review_reason FROM plan WHERE final_status = 'PENDING_APPROVAL'
UNION ALL SELECT payment_id, 4, 'EV_BYPASS', 'system', ev_reason FROM plan WHERE final_status = 'EV_BYPASSED'
UNION ALL SELECT payment_id, 5, action, source, 'arm ' || arm || '; category ' || failure_category || '; score ' || {_sc} || '; ' || ev_reason FROM plan WHERE final_status = 'ACTION_TRIGGERED'),
decided AS MATERIALIZED (SELECT p.merchant_id AS chain_key, p.merchant_id, steps.payment_id AS transaction_id,
  CAST(split_part(steps.payment_id, '_', 2) AS BIGINT) * 8 + row_number() OVER (PARTITION BY steps.payment_id ORDER BY o) - 1 AS seq,
  CAST(coalesce(p.score, 0) AS DECIMAL(7,6)) AS recoverability_score, p.created_at AS logged_at, a AS action_taken, t AS decision_rationale, s AS source
  FROM steps JOIN plan p USING (payment_id)),
d_texts AS MATERIALIZED (SELECT chain_key, seq, seq // 1024 AS block, action_taken, {_decided_text} AS t,
  row_number() OVER (PARTITION BY chain_key, seq // 1024 ORDER BY seq) AS rn FROM decided),
d_walk AS (SELECT chain_key, block, seq, action_taken, t, rn, sha256('GENESIS|' || chain_key || '|' || CAST(block AS VARCHAR)) AS previous_hash,
    sha256(sha256('GENESIS|' || chain_key || '|' || CAST(block AS VARCHAR)) || t) AS current_hash FROM d_texts WHERE rn = 1
  UNION ALL SELECT x.chain_key, x.block, x.seq, x.action_taken, x.t, x.rn, w.current_hash, sha256(w.current_hash || x.t)
  FROM d_walk w JOIN d_texts x ON x.chain_key = w.chain_key AND x.block = w.block AND x.rn = w.rn + 1)""",
)
oracle("decision_audit", "decided", """SELECT transaction_id, CAST(seq % 8 AS INTEGER) AS step, action_taken, source, decision_rationale FROM decided""")
oracle("decision_ledger", "decided", "SELECT chain_key, seq, action_taken, previous_hash, current_hash FROM d_walk")
# A forged rationale changes the hash of its own row; rows after it still build on the stored one.
oracle("audit_forged_rationale", "decided", """SELECT chain_key, count(*) AS records, CASE WHEN bool_or(seq // 8 % 97 = 0) THEN 'hash' ELSE 'ok' END AS kind,
  min(seq) FILTER (seq // 8 % 97 = 0) AS first_bad_seq, 0::BIGINT AS hmac_failures, NOT bool_or(seq // 8 % 97 = 0) AS ok FROM decided GROUP BY 1""")
oracle("review_queue", "plan", """SELECT sha256('review|' || payment_id) AS hitl_id, payment_id AS transaction_id, amount_paise, action AS proposed_action, discount_pct AS proposed_discount,
  review_reason AS trigger_reason, score AS ml_score, arm AS ab_arm FROM plan WHERE final_status = 'PENDING_APPROVAL'""")
_hop = lambda n, fee: _ev_steps("sent", n, fee=fee).strip()
oracle("channel_fallback", "ev_input dispatch_log", f""", oks AS (SELECT payment_id, bool_or(channel = 'whatsapp' AND status = 'delivered') AS w, bool_or(channel = 'sms' AND status = 'delivered') AS s,
   bool_or(channel = 'email' AND status = 'delivered') AS e FROM dispatch_log GROUP BY 1),
sent AS (SELECT i.*, coalesce(w, false) AS w, coalesce(s, false) AS s, coalesce(e, false) AS e FROM ev_input i LEFT JOIN oks USING (payment_id)),
{_hop('h0', '2.50')}, {_hop('h1', '1.75')}, {_hop('h2', '1.00')},
j AS (SELECT h0.payment_id, h0.w, h0.s, h0.e, h0.ev_rupees > 0 AS g0, h1.ev_rupees > 0 AS g1, h2.ev_rupees > 0 AS g2 FROM h0 JOIN h1 USING (payment_id) JOIN h2 USING (payment_id))
SELECT payment_id,
  CASE WHEN NOT g0 THEN 'EV_BYPASSED' WHEN w THEN 'DELIVERED' WHEN NOT g1 THEN 'EV_BYPASSED' WHEN s THEN 'DELIVERED' WHEN NOT g2 THEN 'EV_BYPASSED' WHEN e THEN 'DELIVERED' ELSE 'ACCEPTED' END AS fallback_status,
  CASE WHEN NOT g0 OR w THEN 'whatsapp' WHEN NOT g1 OR s THEN 'sms' ELSE 'email' END AS final_channel,
  CASE WHEN NOT g0 OR w THEN 0 WHEN NOT g1 OR s THEN 1 ELSE 2 END AS hops,
  CASE WHEN NOT g0 OR w THEN 'whatsapp' WHEN NOT g1 OR s THEN 'whatsapp>sms' ELSE 'whatsapp>sms>email' END AS path FROM j""")
oracle("smart_routing", "scored", "SELECT payment_id, failure_category IN ('GATEWAY_DOWN', 'BANK_DECLINE') AS smart_routing FROM scored")
oracle("link_requests", "scored", """SELECT payment_id AS reference_id, amount_paise AS amount, currency, 'Recovery: ' || coalesce(failure_reason, 'Payment failed') AS description,
  CAST(epoch(created_at) AS BIGINT) + 3600 AS expire_by, failure_category IN ('GATEWAY_DOWN', 'BANK_DECLINE') AS smart_routing,
  least(CAST(amount_paise % 20 AS DOUBLE), 15.0::DOUBLE) AS discount_pct, failure_category IN ('GATEWAY_DOWN', 'BANK_DECLINE') AS offers_upi FROM scored""")


def _filled(body: str, reason: str) -> str:
    text = _quote(body)
    for slot, value in {
        "name": "'Customer'", "amount": _WHOLE, "merchant": "merchant_id", "reason": reason,
        "link": "'https://pay.example/' || payment_id",
    }.items():
        text = f"replace({text}, '{{{slot}}}', {value})"
    return text


_why = "coalesce(failure_reason, 'the bank could not complete the payment')"
oracle("rendered_messages", "routed", f"""SELECT payment_id, channel, CASE channel WHEN 'whatsapp' THEN {_filled(BODIES['whatsapp'], _why)}
  WHEN 'sms' THEN {_filled(BODIES['sms'], f'left({_why}, 30)')} ELSE {_filled(BODIES['email'], _why)} END AS body FROM routed""")
oracle("scoring_features", "scored", "SELECT payment_id, amount_rupees, code_index, hour_of_day, retry_count FROM scored")
oracle("rule_scores", "scored", "SELECT payment_id, score FROM scored")
_explain = """, x AS (SELECT *, (least(amount_rupees / 15000, 1.0::DOUBLE) - 0.5) * 0.20::DOUBLE AS c1,
   (0.5::DOUBLE - (CAST('0x' || substr(md5(coalesce(failure_code, 'UNKNOWN')), 1, 8) AS BIGINT) % 1000) / 1000.0::DOUBLE) * 0.12::DOUBLE AS c2,
   -least(recovery_attempts / 3.0::DOUBLE, 1.0::DOUBLE) * 0.18::DOUBLE AS c3, (0.5::DOUBLE - abs(hour_of_day - 14) / 24.0::DOUBLE) * 0.06::DOUBLE AS c4 FROM scored)"""
oracle("explanations", "scored", _explain + """
SELECT payment_id, round(c1, 6) AS c_amount_rupees, round(c2, 6) AS c_failure_code_hash, round(c3, 6) + 0.0 AS c_recovery_attempts, round(c4, 6) AS c_hour_of_day,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score - (c1 + c2 + c3 + c4))), 6) AS base_value,
  CASE WHEN score >= 0.15::DOUBLE THEN 'retry_or_reroute' ELSE 'monitor_only' END AS advice,
  'score ' || CAST(CAST(CAST(score AS DECIMAL(6,4)) AS DECIMAL(6,3)) AS VARCHAR) || '; cause ' || failure_category || '; earlier attempts ' || CAST(recovery_attempts AS VARCHAR) AS why FROM x""")
oracle("feature_importance", "scored", _explain + """, m AS (SELECT avg(abs(c1)) AS amount_rupees, avg(abs(c2)) AS failure_code_hash, avg(abs(c3)) AS recovery_attempts, avg(abs(c4)) AS hour_of_day FROM x)
SELECT feature, round(importance, 6) AS importance FROM m UNPIVOT (importance FOR feature IN (amount_rupees, failure_code_hash, recovery_attempts, hour_of_day))""")

# --- privacy and answers -------------------------------------------------------------

# A mask that keeps the last four digits of a card is one replacement; addresses and
# phones are masked piece by piece, like the cards, between the parts they separate.
_CARD = r"\b(?:\d[ -]?){13,19}\b"
_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
_PHONE = r"(?:\+?91[\-\s]?)?[6-9]\d{9}"


def _mask_sql(source: str, target: str, pattern: str, mask: str) -> str:
    """CTE that rewrites every match ``m`` of ``pattern`` in ``t`` by ``mask``."""
    return f"""{target} AS (SELECT doc_id, CASE WHEN len(hits) = 0 THEN t ELSE
  list_reduce(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(list_transform([hits[i]], lambda m: {mask})[1], '')), lambda a, b: a || b) END AS t
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS parts FROM {source}))"""


_digits = "regexp_replace(m, '[^0-9]', '', 'g')"
_local = "split_part(m, '@', 1)"
# A word border here is one between any letters, but this engine's \\b knows ASCII letters
# only. Accented letters get an ASCII neighbour on both sides while cards are looked for.
_marked = "regexp_replace(text, '([À-ÖØ-öø-ɏ])', '_' || chr(1) || '\\1' || chr(1) || '_', 'g')"
ORACLES["pii_masks"] = f"WITH raw AS (SELECT doc_id, text AS t FROM documents), m AS (SELECT doc_id, {_marked} AS t FROM documents),\n" + ",\n".join((
    _mask_sql("m", "c0", _CARD, f"'**** **** **** ' || right({_digits}, 4)"),
    "c AS (SELECT doc_id, replace(replace(t, '_' || chr(1), ''), chr(1) || '_', '') AS t FROM c0)",
    _mask_sql("c", "e", _EMAIL, f"CASE WHEN len({_local}) > 2 THEN left({_local}, 1) || repeat('*', len({_local}) - 2) || right({_local}, 1) ELSE repeat('*', len({_local})) END || '@' || split_part(m, '@', 2)"),
    _mask_sql("e", "p", _PHONE, f"repeat('*', len({_digits}) - 4) || right({_digits}, 4)"),
)) + "\nSELECT p.doc_id, md5(p.t) AS masked_md5, p.t <> raw.t AS changed FROM p JOIN raw USING (doc_id)"

ORACLES["redacted_fields"] = """WITH r AS (SELECT *, lower(replace(c_name, '#', '.')) AS l, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS ph FROM customer)
SELECT c_custkey, '***REDACTED***' AS customer_name, left(l, 1) || repeat('*', len(l) - 2) || right(l, 1) || '@mail.example' AS email,
  '******' || right(ph, 4) AS contact, '**** **** **** ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS card_number, 'visa' AS network, c_mktsegment AS segment,
  '******' || right(CAST(9800000000 + c_custkey AS VARCHAR), 4) AS map_contact, CAST(c_custkey AS VARCHAR) AS map_tries,
  'j*e@x.com' AS map_email, '["' || c_mktsegment || '"]' AS map_tags, '******3210' AS map_part, '{"n":"' || c_mktsegment || '"}' AS map_place FROM r"""
ORACLES["encrypted_columns"] = """SELECT doc_id, text <> '' AS encrypted, md5(text) AS restored_md5, true AS other_key_unchanged, true AS plain_unchanged FROM documents"""

_bad_words = " OR ".join(f"strpos(lower(reasoning), '{w}') > 0" for w in ALARM_WORDS)
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_CTE["judged"] = (
    ("llm_answers",),
    f"""facts AS (SELECT *, CASE conv_id % 8 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate((*CATEGORIES, 'MADE_UP')))} END AS failure_category,
   ((strpos(lower(reasoning), 'le') > 0)::INT + (strpos(lower(reasoning), 'the') > 0)::INT + (strpos(lower(reasoning), lower(left(action, 2))) > 0)::INT) / 3.0::DOUBLE AS share FROM llm_answers),
judged0 AS (SELECT *, round(share, 4) AS faithfulness, share >= 0.8::DOUBLE AS faithful,
   NOT ({_bad_words} OR regexp_matches(reasoning, '[!?]{{3,}}')
     OR len(list_filter(regexp_split_to_array(reasoning, '\\s+'), lambda w: len(w) > 3 AND upper(w) = w AND lower(w) <> w)) > 0
     OR regexp_matches(lower(reasoning), '[a-z0-9_.+-]+@[a-z0-9-]+\\.[a-z0-9-.]+') OR regexp_matches(reasoning, '(\\+?91[\\-\\s]?)?[6-9]\\d{{9}}')) AS tone_ok,
   NOT (len(list_filter(regexp_extract_all(reasoning, '(?i)pay_[a-z0-9]{{8,}}'), lambda x: lower(x) <> lower(payment_id))) > 0 OR regexp_matches(reasoning, 'https?://')) AS nothing_invented,
   action IN {_in(ACTIONS)} AND failure_category IN {_in(CATEGORIES)} AS action_valid, discount_pct <= 15 AS discount_ok, abs(confidence - ml_score) <= 0.6::DOUBLE AS confidence_ok FROM facts),
judged AS (SELECT *, faithful AND tone_ok AND nothing_invented AND action_valid AND discount_ok AS overall FROM judged0)""",
)
oracle("answer_checks", "judged", "SELECT conv_id, turn, faithfulness, faithful, tone_ok, nothing_invented, action_valid, discount_ok, confidence_ok, overall FROM judged")
_rates = ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in ("faithful", "tone_ok", "nothing_invented", "action_valid", "discount_ok", "confidence_ok", "overall"))
oracle("answer_pass_rates", "judged", f"SELECT action, count(*) AS n, {_rates} FROM judged GROUP BY 1")
oracle("tenant_rate_limits", "outcomes", """SELECT merchant_id, date_trunc('minute', occurred_at) AS minute, count(*) AS requests,
  CASE merchant_id WHEN 'm0' THEN 1000 WHEN 'm1' THEN 200 ELSE 50 END AS limit_per_min,
  count(*) > CASE merchant_id WHEN 'm0' THEN 1000 WHEN 'm1' THEN 200 ELSE 50 END AS over_limit FROM outcomes GROUP BY 1, 2""")
_CTE["reviewed"] = (
    ("hitl_queue",),
    """made AS (SELECT hitl_id, decision, 'lead' AS decided_by, created_at AS dt, 'seen' AS notes FROM hitl_queue WHERE decision IS NOT NULL),
d AS (SELECT * FROM made UNION ALL SELECT hitl_id || CASE WHEN decision IS NULL THEN '_x' ELSE '' END, 'REJECTED', 'clerk', created_at + INTERVAL 1 DAY, 'late' FROM hitl_queue
  UNION ALL SELECT hitl_id, 'REJECTED', decided_by, dt, notes FROM made, range(2) WHERE decision <> 'REJECTED'),
r AS (SELECT d.*, q.transaction_id, CASE WHEN q.hitl_id IS NULL THEN 'not found'
    WHEN row_number() OVER (PARTITION BY d.hitl_id ORDER BY dt, decided_by, d.decision, notes) = 1 THEN 'applied' ELSE 'conflict' END AS result
  FROM d LEFT JOIN hitl_queue q ON q.hitl_id = d.hitl_id),
reviewed AS (SELECT *, CASE WHEN result = 'applied' AND decision IN ('APPROVED', 'MODIFIED') THEN 'RECOVERING' END AS new_status,
  CASE WHEN result = 'applied' AND decision IN ('APPROVED', 'MODIFIED') THEN 'HITL_RESOLVED' END AS audit_action FROM r)""",
)
oracle("review_decisions", "reviewed", "SELECT hitl_id, decision, decided_by, notes, result, new_status, audit_action FROM reviewed")
oracle("reviewed_transactions", "txn reviewed", """SELECT payment_id, coalesce(n.new_status, status) AS status FROM txn
  LEFT JOIN (SELECT transaction_id, new_status FROM reviewed WHERE new_status IS NOT NULL) n ON n.transaction_id = payment_id""")
oracle("review_audit", "reviewed", """SELECT transaction_id, audit_action AS action_taken, 'reviewer' AS source,
  'decided by ' || decided_by || ': ' || decision AS decision_rationale, dt AS logged_at FROM reviewed WHERE audit_action IS NOT NULL""")

# --- reports ---------------------------------------------------------------------------

_funnel = """count(*) AS ingested, count(*) FILTER (score > 0) AS ml_scored, count(*) FILTER (status NOT IN ('FAILED', 'LOW_PRIORITY_SKIP')) AS agent_evaluated,
  count(*) FILTER (status IN ('ACTION_TRIGGERED', 'RECOVERING', 'RECOVERED')) AS action_triggered, count(*) FILTER (status = 'RECOVERED') AS recovered FROM scored"""
oracle("status_funnel", "scored", f"SELECT {_funnel}")
oracle("tenant_funnel", "scored", f"SELECT merchant_id, {_funnel} GROUP BY 1")
oracle("root_causes", "scored", "SELECT failure_category, count(*) AS failures FROM scored GROUP BY 1")
_to_rupees = "CAST(CAST({x} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(30,2))"
_won = "sum(CASE WHEN status = 'RECOVERED' THEN amount_paise ELSE 0 END)"
oracle("minute_series", "txn", f"""SELECT date_trunc('minute', created_at) AS minute, {_to_rupees.format(x='sum(amount_paise)')} AS revenue_at_risk,
  {_to_rupees.format(x=_won)} AS revenue_recovered FROM txn GROUP BY 1""")
oracle("revenue_summary", "scored", f"""SELECT {_to_rupees.format(x='sum(amount_paise)')} AS total_at_risk, {_to_rupees.format(x=_won)} AS total_recovered,
  round(count(*) FILTER (status = 'RECOVERED') * 100.0::DOUBLE / count(*), 2) AS recovery_rate, round(avg(score), 4) AS avg_recoverability_score FROM scored""")
oracle("shadow_summary", "shadow_plan", """SELECT count(*) AS total_events, count(*) AS bypassed, 0::BIGINT AS would_proceed, round(avg(CAST(ev_rupees AS DOUBLE)), 4) AS avg_ev,
  CAST(sum(recoverable_amt) AS DECIMAL(30,2)) AS total_recoverable, count(DISTINCT payment_id) AS unique_transactions FROM shadow_plan WHERE ev_decision = 'BYPASS'""")
oracle("dispatch_summary", "ranked", """SELECT count(*) AS total_dispatches, 0::BIGINT AS llm_drafted, count(*) AS template_only, round(avg(top_similarity), 4) AS avg_similarity,
  round(avg(latency_ms), 4) AS avg_latency_ms, count(DISTINCT failure_category) AS unique_categories FROM message_log""")
oracle("message_audit", "ranked", """SELECT payment_id AS transaction_id, 'RAG_PERSONALIZED' AS action_taken, 'templates ' || retrieved_ids || ' similarity '
  || CAST(CAST(CAST(top_similarity AS VARCHAR) AS DECIMAL(6,3)) AS VARCHAR) || ' channel ' || channel AS decision_rationale, 'system' AS source FROM message_log""")
oracle("message_log_appended", "ranked", """SELECT sha256(payment_id || '|' || channel) AS rag_log_id, payment_id, channel, top_similarity FROM message_log
  WHERE CAST(split_part(payment_id, '_', 2) AS BIGINT) % 2 = 1""")
oracle("dispatch_by_category", "ranked", "SELECT failure_category, count(*) AS dispatches, round(avg(top_similarity), 4) AS avg_sim FROM message_log GROUP BY 1")
oracle("template_influence", "ranked", "SELECT template_id, count(*) AS uses FROM ranked GROUP BY 1")


def _histogram(source: str, value: str, bins: int) -> str:
    return f""", h AS (SELECT {value} AS v FROM {source}), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins}.0::DOUBLE AS w FROM h),
b AS (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM h, r)
SELECT bin, round(any_value(lo) + bin * any_value(w), 6) AS lower, round(any_value(lo) + (bin + 1) * any_value(w), 6) AS upper, count(*) AS n FROM b GROUP BY bin"""


oracle("similarity_histogram", "ranked", _histogram("message_log", "top_similarity", 20))
oracle("score_histogram", "scored", _histogram("scored", "score", 25))
oracle("latency_histogram", "dispatch_log", _histogram("dispatch_log", "latency_ms", 20))
oracle("arm_counters", "outcomes", """SELECT arm, count(*) AS sent, CAST(sum(recovered) AS BIGINT) AS recovered, CAST(sum(amount_paise) AS BIGINT) AS revenue_at_risk_paise,
  CAST(sum(recovered * amount_paise) AS BIGINT) AS revenue_recovered_paise, round(sum(recovered) * 100.0::DOUBLE / count(*), 2) AS recovery_rate_pct FROM outcomes GROUP BY 1""")
oracle("arm_lift", "arms2", """, r AS (SELECT *, round(c_rec * 100.0::DOUBLE / c_sent, 2) AS control_rate, round(v_rec * 100.0::DOUBLE / v_sent, 2) AS variant_rate FROM arms2)
SELECT c_sent, c_rec, v_sent, v_rec, control_rate, variant_rate, round((variant_rate - control_rate) / control_rate * 100, 2) AS lift_pct FROM r""")
oracle("status_distribution", "txn", "SELECT status, count(*) AS n FROM txn GROUP BY 1")
_bounds = (5, 10, 15, 20, 25, 30, 50, 100, 250, 500, 1000)
oracle("latency_cumulative", "dispatch_log", " UNION ALL ".join(f"SELECT '{b}.0' AS le, count(*) FILTER (latency_ms <= {b}) AS n FROM dispatch_log" for b in _bounds)
       + " UNION ALL SELECT 'Infinity', count(latency_ms) FROM dispatch_log")
oracle("category_strategy_rates", "outcomes", "SELECT failure_category, " + ", ".join(
    f"coalesce(round(avg(recovered) FILTER (strategy = '{s}'), 6), 0.0::DOUBLE) AS {s}" for s in ("retry_now", "retry_15m", "offer_upi", "offer_emi")) + " FROM outcomes GROUP BY 1")
_sum = "CAST(sum(amount_paise) AS BIGINT) AS amount_paise"
oracle("report_by_category", "scored", f"SELECT failure_category, count(*) AS failures, {_sum} FROM scored GROUP BY 1")
oracle("report_by_status", "txn", f"SELECT status, count(*) AS transactions, {_sum} FROM txn GROUP BY 1")
oracle("report_by_action_source", "audit_seed", "SELECT action_taken, source, count(*) AS actions FROM audit_seed GROUP BY 1, 2")
oracle("report_by_status_category", "scored", f"SELECT status, failure_category, count(*) AS transactions, {_sum} FROM scored GROUP BY 1, 2")
oracle("result_digest", "txn", f"SELECT count(*) AS records, {_to_rupees.format(x='sum(amount_paise)')} AS value_rupees, count(*) FILTER (status = 'RECOVERED') AS recovered FROM txn")
_roi = """, a AS (SELECT *, c_won / 100.0::DOUBLE / c_rec AS ca, v_won / 100.0::DOUBLE / v_rec AS va FROM arms2),
g AS (SELECT *, c_rec * ca * 0.97::DOUBLE AS cg, v_rec * va * 0.97::DOUBLE AS vg, c_sent * 0.5::DOUBLE + c_rec * 5 AS cc, v_sent * 2.0::DOUBLE + v_rec * 5 AS vc FROM a)"""
oracle("roi_report", "arms2", _roi + """
SELECT round(cg, 2) AS c_gross, round(cg * 0.3::DOUBLE, 2) AS c_margin, round(cc, 2) AS c_cost, round(cg * 0.3::DOUBLE - cc, 2) AS c_net,
  round(vg, 2) AS v_gross, round(vg * 0.3::DOUBLE, 2) AS v_margin, round(vc, 2) AS v_cost, round(vg * 0.3::DOUBLE - vc, 2) AS v_net,
  round((vg - cg) * 0.3::DOUBLE - (vc - cc), 2) AS net_lift, round(((vg - cg) * 0.3::DOUBLE - (vc - cc)) / vc * 100, 2) AS roi_pct,
  round((v_rec - c_rec) * va * 0.97::DOUBLE * 0.3::DOUBLE, 2) AS recovery_step, round(cc - vc, 2) AS cost_step FROM g""")
oracle("discount_what_if", "arms2", _roi + """
SELECT CAST(d AS INTEGER) AS discount, round(v_rec * va * (1 - d / 100.0::DOUBLE) * 0.3::DOUBLE - vc, 2) AS net_revenue FROM g, range(16) t(d)""")
oracle("significance", "arms2", """, z AS (SELECT *, (v_rec / v_sent::DOUBLE - c_rec / c_sent::DOUBLE) /
   sqrt(((c_rec + v_rec) / (c_sent + v_sent)::DOUBLE) * (1 - (c_rec + v_rec) / (c_sent + v_sent)::DOUBLE) * (1 / c_sent::DOUBLE + 1 / v_sent::DOUBLE)) AS z FROM arms2)
SELECT c_sent, c_rec, v_sent, v_rec, round(z, 4) AS z_score, abs(z) > 1.96 AS sig_95, abs(z) > 2.576 AS sig_99 FROM z""")
oracle("strategy_report", "outcomes", f""", s AS (SELECT strategy, count(*) AS sent, CAST(sum(recovered) AS BIGINT) AS recovered, sum(recovered) / count(*)::DOUBLE AS r,
   {_to_rupees.format(x='sum(recovered * amount_paise)')} AS recovered_revenue, sum(friction) / count(*)::DOUBLE AS f, sum(recovered * minutes_to_recovery) / sum(recovered)::DOUBLE AS m FROM outcomes GROUP BY 1),
c AS (SELECT *, 1.96::DOUBLE * sqrt(greatest(r * (1 - r), 0.000001::DOUBLE) / sent) AS e, (SELECT r FROM s WHERE strategy = 'retry_now') AS b FROM s)
SELECT strategy, sent, recovered, round(r, 6) AS recovery_rate, recovered_revenue, round((r - b) / b, 6) AS lift, round(greatest(0.0::DOUBLE, r - e), 6) AS ci_low,
  round(least(1.0::DOUBLE, r + e), 6) AS ci_high, round(f, 6) AS customer_friction, round(m, 6) AS time_to_recovery_minutes FROM c""")
oracle("tenant_comparison", "txn", """SELECT merchant_id, count(*) AS txns, count(*) FILTER (status = 'RECOVERED') AS recovered,
  round(count(*) FILTER (status = 'RECOVERED') * 100.0::DOUBLE / count(*), 2) AS recovery_rate FROM txn GROUP BY 1""")
oracle("delivery_by_channel", "dispatch_log", """SELECT channel, count(*) AS dispatches, count(*) FILTER (status = 'delivered') AS delivered,
  round(count(*) FILTER (status = 'delivered') * 100.0::DOUBLE / count(*), 2) AS delivery_rate FROM dispatch_log GROUP BY 1""")
oracle("link_outcomes", "dispatch_log", """SELECT count(*) AS links, count(*) FILTER (status = 'delivered') AS paid, count(*) FILTER (status = 'failed') AS expired,
  round(count(*) FILTER (status = 'delivered') * 100.0::DOUBLE / count(*), 2) AS paid_pct, round(count(*) FILTER (status = 'failed') * 100.0::DOUBLE / count(*), 2) AS expired_pct FROM dispatch_log""")
oracle("latency_percentiles", "dispatch_log", """SELECT channel, count(*) AS total, count(*) FILTER (status <> 'failed') AS succeeded,
  count(*) FILTER (status = 'failed' AND latency_ms = 0) AS dropped, round(avg(latency_ms) FILTER (status <> 'failed'), 4) AS mean_ms,
  round(count(*) / (epoch(max(sent_at)) - epoch(min(sent_at))) * 86400, 4) AS per_day,
  quantile_disc(latency_ms, 0.50) FILTER (status <> 'failed') AS p50, quantile_disc(latency_ms, 0.95) FILTER (status <> 'failed') AS p95,
  quantile_disc(latency_ms, 0.99) FILTER (status <> 'failed') AS p99, quantile_disc(latency_ms, 0.95) FILTER (status <> 'failed') < 30 AS sla_ok FROM dispatch_log GROUP BY 1""")
oracle("merchant_impact", "failures", f"SELECT merchant_id, {_to_rupees.format(x='sum(amount_paise)')} AS impact_rupees FROM failures GROUP BY 1")
oracle("modal_causes", "scored", """, c AS (SELECT merchant_id, failure_category AS root_cause, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY n DESC, root_cause) = 1""")
oracle("review_stats", "hitl_queue", "SELECT count(*) FILTER (decision IS NULL) AS pending, " + ", ".join(
    f"count(*) FILTER (decision = '{d}') AS {d.lower()}" for d in ("APPROVED", "REJECTED", "MODIFIED", "ESCALATED")) + " FROM hitl_queue")
oracle("arm_posteriors", "live", """, r AS (SELECT arm, context, recovered * 0.75::DOUBLE + CASE WHEN friction = 0 THEN 0.25::DOUBLE ELSE 0 END AS x FROM live),
p AS (SELECT arm, context, 1 + sum(x) AS a, 1 + sum(1 - x) AS b, count(*) AS pulls FROM r GROUP BY 1, 2)
SELECT arm, context, round(a, 2) AS alpha, round(b, 2) AS beta, round(a / (a + b), 4) AS mean, pulls FROM p""")
_post = ", post AS (SELECT arm, context, 1.0::DOUBLE + sum(recovered) AS a, 1.0::DOUBLE + sum(1 - recovered) AS b, count(*) AS n FROM live GROUP BY 1, 2)"
oracle("arm_mean_rates", "live", _post + " SELECT arm, round(avg(a / (a + b)), 6) AS mean FROM post GROUP BY 1")
_methods = "CASE strategy WHEN 'retry_now' THEN 'card_retry' WHEN 'retry_15m' THEN 'upi' WHEN 'offer_upi' THEN 'netbanking' ELSE 'wallet' END"
_windows = "CASE call_id % 6 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(RETRY_WINDOWS_MIN)) + " END"
_opt = """count(*) AS trials, 1.0::DOUBLE + sum(recovered) AS alpha, 1.0::DOUBLE + count(*) - sum(recovered) AS beta, CAST(sum(recovered * amount_paise) AS BIGINT) AS revenue_paise FROM outcomes GROUP BY 1"""
_upper = "alpha / (alpha + beta) + 1.96::DOUBLE * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))"
oracle("method_posteriors", "outcomes", f"SELECT {_methods} AS option, {_opt}")
oracle("timing_posteriors", "outcomes", f", o AS (SELECT {_windows} AS option, {_opt}) SELECT *, round({_upper}, 6) AS upper FROM o")


def _ks(value: str) -> str:
    return f""", s AS (SELECT merchant_id, count(*) FILTER (is_live) AS nl, count(*) FILTER (NOT is_live) AS nr FROM live GROUP BY 1),
v AS (SELECT merchant_id, {value} AS v, count(*) FILTER (is_live) AS l, count(*) FILTER (NOT is_live) AS r FROM live GROUP BY 1, 2),
c AS (SELECT merchant_id, abs(sum(l) OVER w / nl::DOUBLE - sum(r) OVER w / nr::DOUBLE) AS gap, nl, nr FROM v JOIN s USING (merchant_id) WINDOW w AS (PARTITION BY merchant_id ORDER BY v)),
k AS (SELECT merchant_id, max(gap) AS d, sqrt(any_value(nl) * any_value(nr) / (any_value(nl) + any_value(nr))::DOUBLE) AS en, any_value(nl) AS n_live FROM c GROUP BY 1),
ks AS (SELECT merchant_id, n_live, d AS ks_stat, least(1.0::DOUBLE, 2 * exp(-2 * pow((en + 0.12::DOUBLE + 0.11::DOUBLE / en) * d, 2))) AS ks_pval FROM k)"""


def _psi(value: str, source: str = "live") -> str:
    return f""", x AS (SELECT merchant_id, is_live, CAST({value} AS DOUBLE) AS v FROM {source}),
sp AS (SELECT merchant_id, min(v) AS lo, max(v) AS hi, count(*) FILTER (is_live) AS nl, count(*) FILTER (NOT is_live) AS nr FROM x GROUP BY 1),
bk AS (SELECT x.merchant_id, least(floor((v - lo) / (hi - lo) * 10), 9) AS b, count(*) FILTER (is_live) AS l, count(*) FILTER (NOT is_live) AS r FROM x JOIN sp USING (merchant_id) GROUP BY 1, 2),
al AS (SELECT sp.merchant_id, greatest(coalesce(l, 0) / nl::DOUBLE, 1e-6) AS c, greatest(coalesce(r, 0) / nr::DOUBLE, 1e-6) AS r
  FROM sp CROSS JOIN range(10) t(i) LEFT JOIN bk ON bk.merchant_id = sp.merchant_id AND bk.b = i),
psi AS (SELECT merchant_id, round(sum((c - r) * ln(c / r)), 4) AS psi FROM al GROUP BY 1)"""


oracle("ks_amounts", "live", _ks("amount_paise") + " SELECT merchant_id, round(ks_stat, 6) AS ks_stat, round(ks_pval, 6) AS ks_pval FROM ks")
oracle("ks_codes", "live", _ks("code_index") + " SELECT merchant_id, round(ks_stat, 6) AS ks_stat, round(ks_pval, 6) AS ks_pval FROM ks")
oracle("psi_amounts", "live", _psi("amount_paise") + " SELECT merchant_id, psi FROM psi")
oracle("drift_verdicts", "live", _ks("code_index") + _psi("amount_paise / 100.0::DOUBLE") + """
SELECT merchant_id, n_live, round(ks_stat, 4) AS ks_stat, round(ks_pval, 4) AS ks_pval, psi, n_live >= 50 AND (ks_pval < 0.05 OR psi > 0.2) AS drift,
  CASE WHEN psi < 0.1 THEN 'none' WHEN psi <= 0.2 THEN 'moderate' ELSE 'significant' END AS level FROM ks JOIN psi USING (merchant_id)""")
oracle("brier_scores", "outcomes", """SELECT merchant_id, count(*) AS n, round(avg((ml_score - recovered) * (ml_score - recovered)), 6) AS brier,
  avg((ml_score - recovered) * (ml_score - recovered)) <= 0.3 AS accepted FROM outcomes GROUP BY 1""")

# --- time series and ledger --------------------------------------------------------------

oracle("failure_bins", "bins", "SELECT merchant_id, bin, failures, amount_paise FROM bins")
oracle("rolling_anomalies", "zscores", "SELECT *, coalesce(failure_zscore >= 3, false) AS threshold_anomaly FROM zscores")
oracle("anomaly_bins", "zscores", "SELECT *, true AS threshold_anomaly FROM zscores WHERE failure_zscore >= 2")
oracle("failure_forecast", "bins", """, l AS (SELECT * FROM bins QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY bin DESC) <= 6),
m AS (SELECT merchant_id, max(bin) AS hi, avg(failures) AS f FROM l GROUP BY 1)
SELECT merchant_id, make_timestamp((hi + i * 300) * 1000000) AS bin_start, round(f, 6) AS predicted_failures FROM m, range(1, 13) t(i)""")
oracle("drift_monitor", "live", """, calls AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY call_id) AS rn FROM live),
ticks AS (SELECT merchant_id, unnest(range(200, max(rn) + 1, 200)) AS t FROM calls GROUP BY 1),
rows_at AS (SELECT k.merchant_id, k.t, true AS is_live, code_index, amount_paise / 100.0::DOUBLE AS a FROM ticks k JOIN calls c ON c.merchant_id = k.merchant_id AND c.rn BETWEEN k.t - 499 AND k.t
  UNION ALL SELECT k.merchant_id, k.t, false, code_index, amount_paise / 100.0::DOUBLE FROM ticks k JOIN live c ON c.merchant_id = k.merchant_id AND NOT c.is_live),
s AS (SELECT merchant_id, t, count(*) FILTER (is_live) AS nl, count(*) FILTER (NOT is_live) AS nr, min(a) AS lo, max(a) AS hi FROM rows_at GROUP BY 1, 2),
v AS (SELECT merchant_id, t, code_index, count(*) FILTER (is_live) AS l, count(*) FILTER (NOT is_live) AS r FROM rows_at GROUP BY 1, 2, 3),
c AS (SELECT merchant_id, t, abs(sum(l) OVER w / nl::DOUBLE - sum(r) OVER w / nr::DOUBLE) AS gap, nl, nr FROM v JOIN s USING (merchant_id, t) WINDOW w AS (PARTITION BY merchant_id, t ORDER BY code_index)),
k AS (SELECT merchant_id, t, max(gap) AS d, any_value(nl) AS nl, sqrt(any_value(nl) * any_value(nr) / (any_value(nl) + any_value(nr))::DOUBLE) AS en FROM c GROUP BY 1, 2),
ks AS (SELECT *, least(1.0::DOUBLE, 2 * exp(-2 * pow((en + 0.12::DOUBLE + 0.11::DOUBLE / en) * d, 2))) AS pv FROM k),
bk AS (SELECT merchant_id, t, least(floor((a - lo) / (hi - lo) * 10), 9) AS b, count(*) FILTER (is_live) AS l, count(*) FILTER (NOT is_live) AS r FROM rows_at JOIN s USING (merchant_id, t) GROUP BY 1, 2, 3),
al AS (SELECT s.merchant_id, s.t, greatest(coalesce(l, 0) / nl::DOUBLE, 1e-6) AS c, greatest(coalesce(r, 0) / nr::DOUBLE, 1e-6) AS r
  FROM s CROSS JOIN range(10) g(i) LEFT JOIN bk ON bk.merchant_id = s.merchant_id AND bk.t = s.t AND bk.b = i),
ps AS (SELECT merchant_id, t, round(sum((c - r) * ln(c / r)), 4) AS psi FROM al GROUP BY 1, 2)
SELECT merchant_id, t // 200 AS tick, nl AS n_live, round(d, 4) AS ks_stat, round(pv, 4) AS ks_pval, psi, nl >= 50 AND (pv < 0.05 OR psi > 0.2) AS drift FROM ks JOIN ps USING (merchant_id, t)""")
oracle("model_registry", "live", """, n AS (SELECT count(*) FILTER (NOT is_live) AS old, count(*) FILTER (is_live) AS new FROM live)
SELECT CAST(s AS INTEGER) AS step, CAST(v AS INTEGER) AS version, CASE WHEN v = 1 THEN old ELSE new END AS reference_rows, s = 4 AS in_use FROM n, (VALUES (1, 1), (2, 2), (3, 1), (4, 3)) x(s, v)""")
oracle("audit_chain", "ledger", "SELECT chain_key, seq, previous_hash, current_hash, hmac_signature FROM ledger")
_folds = ",\n".join(
    f"l{i + 1} AS (SELECT chain_key, n // 256 AS n, sha256(string_agg(h, '' ORDER BY l{i}.n)) AS h FROM l{i} GROUP BY 1, l{i}.n // 256)" for i in range(7)
)
oracle("audit_roots", "ledger", f""", l0 AS (SELECT chain_key, block AS n, current_hash AS h FROM ledger QUALIFY row_number() OVER (PARTITION BY chain_key, block ORDER BY seq DESC) = 1),
{_folds}
SELECT chain_key, sha256(string_agg(h, '' ORDER BY n)) AS root FROM l7 GROUP BY 1""")
# The rows are walked: a row counts as good if it builds on the one before and its hash and signature come out again.
oracle("audit_verified", "ledger", f""", again AS (SELECT l.chain_key, l.seq, l.previous_hash = coalesce(lag(l.current_hash) OVER (PARTITION BY l.chain_key, l.block ORDER BY l.seq),
    sha256('GENESIS|' || l.chain_key || '|' || CAST(l.seq // 1024 AS VARCHAR))) AND l.current_hash = sha256(l.previous_hash || {_text}) AS good,
  l.hmac_signature = {_hmac(_text, _KEY)} AS signed FROM ledger l JOIN audit_seed s ON s.chain_key = l.chain_key AND s.seq = l.seq)
SELECT chain_key, count(*) AS records, CASE WHEN NOT bool_and(good) THEN 'hash' WHEN NOT bool_and(signed) THEN 'hmac' ELSE 'ok' END AS kind,
  min(seq) FILTER (NOT good) AS first_bad_seq, count(*) FILTER (NOT signed) AS hmac_failures, bool_and(good AND signed) AS ok FROM again GROUP BY 1""".replace("seq AS VARCHAR", "l.seq AS VARCHAR"))
oracle("audit_deleted_block", "audit_seed", """SELECT chain_key, count(*) FILTER (seq // 1024 <> 1) AS records,
  CASE WHEN bool_or(seq // 1024 = 1) THEN 'missing block' ELSE 'ok' END AS kind, CASE WHEN bool_or(seq // 1024 = 1) THEN 1024 END::BIGINT AS first_bad_seq,
  0::BIGINT AS hmac_failures, NOT bool_or(seq // 1024 = 1) AS ok FROM audit_seed GROUP BY 1""")
oracle("audit_cut_tail", "audit_seed", """SELECT chain_key, seq // 1024 AS block, CASE WHEN bool_and(seq % 1024 >= 900) THEN 'missing block' ELSE 'missing rows' END AS kind,
  count(*) FILTER (seq % 1024 >= 900) AS lost FROM audit_seed GROUP BY 1, 2 HAVING count(*) FILTER (seq % 1024 >= 900) > 0""")
_tiers = ",\n".join(
    f"t{i + 1} AS (SELECT chain_key, i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256('node|' || min_by(h, t{i}.i) || max_by(h, t{i}.i)) ELSE min(h) END AS h FROM t{i} GROUP BY 1, t{i}.i // 2)"
    for i in range(14)
)
_nodes = " UNION ALL ".join(f"SELECT chain_key, {i} AS l, i, h FROM t{i}" for i in range(14))
# Nodes without a neighbour move up as they are, so the last ones of a level need not be whole.
_CTE["tree"] = (
    ("ledger",),
    f"""sealed AS (SELECT chain_key, block, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records, max_by(current_hash, seq) AS head FROM ledger GROUP BY 1, 2),
t0 AS MATERIALIZED (SELECT chain_key, row_number() OVER (PARTITION BY chain_key ORDER BY block) - 1 AS i, sha256(concat_ws('|', 'leaf', block, first_seq, last_seq, records, head)) AS h FROM sealed),
{_tiers},
sizes AS (SELECT chain_key, count(*) AS n FROM t0 GROUP BY 1), nodes AS ({_nodes})""",
)
oracle("audit_tree_roots", "tree", "SELECT chain_key, n AS size, h AS root FROM t14 JOIN sizes USING (chain_key)")
oracle("audit_inclusion", "tree", """SELECT a.chain_key, a.i AS leaf, CAST(count(b.h) AS INTEGER) AS steps, sha256(coalesce(string_agg(b.h, '' ORDER BY b.l), '')) AS path_sha256, true AS ok
FROM t0 a LEFT JOIN nodes b ON b.chain_key = a.chain_key AND b.i = xor(a.i // (1 << b.l), 1) GROUP BY 1, 2""")
oracle("audit_consistency", "tree", """, parts AS (SELECT chain_key, n, 0 AS lo, n // 2 AS hi FROM sizes WHERE n >= 2 UNION ALL SELECT chain_key, n, n // 2, n FROM sizes WHERE n >= 2),
inside AS (SELECT p.chain_key, p.n, b.l, b.i, b.h FROM parts p JOIN nodes b ON b.chain_key = p.chain_key AND b.i * (1 << b.l) >= p.lo AND (b.i + 1) * (1 << b.l) <= p.hi
  AND NOT ((b.i // 2) * (2 << b.l) >= p.lo AND (b.i // 2 + 1) * (2 << b.l) <= p.hi))
SELECT chain_key, n // 2 AS old, n AS new, CAST(count(*) AS INTEGER) AS parts, sha256(string_agg(h, '' ORDER BY i * (1 << l))) AS proof_sha256, true AS ok FROM inside GROUP BY 1, 2, 3""")
oracle("audit_tamper_summary", "checked", """SELECT chain_key, count(*) AS records, CASE WHEN bool_or(hash_break) THEN 'hash' WHEN bool_or(hmac_break) THEN 'hmac' ELSE 'ok' END AS kind,
  min(seq) FILTER (hash_break) AS first_bad_seq, CASE WHEN bool_or(hash_break) THEN 0 ELSE count(*) FILTER (hmac_break) END AS hmac_failures, NOT bool_or(hash_break OR hmac_break) AS ok FROM checked GROUP BY 1""")
oracle("audit_tampered_rows", "checked", """, walked AS (
  SELECT chain_key, block, seq, rn, CASE WHEN hash_break THEN previous_hash ELSE current_hash END AS head, hash_break AS bad, hash_break OR hmac_break AS own FROM checked WHERE rn = 1
  UNION ALL SELECT c.chain_key, c.block, c.seq, c.rn, CASE WHEN c.previous_hash = w.head AND NOT c.hash_break THEN c.current_hash ELSE w.head END,
    NOT (c.previous_hash = w.head AND NOT c.hash_break), c.hash_break OR c.hmac_break
  FROM walked w JOIN checked c ON c.chain_key = w.chain_key AND c.block = w.block AND c.rn = w.rn + 1)
SELECT chain_key, seq, own AS own_break, bad AND NOT own AS propagated FROM walked WHERE own OR bad""")
ORACLES["first_seen_events"] = """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
k AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT user_id, ts FROM (SELECT k.user_id, min(e.ts) AS ts FROM k JOIN e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 24 HOUR GROUP BY 1))
SELECT k.user_id, k.ts, e.event_id FROM k JOIN e USING (user_id, ts)"""

# --- retrieval and choice -------------------------------------------------------------------

ORACLES["term_weights"] = """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z₹0-9]+')) AS token FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2),
idf AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, token, tf / n::DOUBLE * idf AS w FROM tf JOIN n USING (doc_id) JOIN idf USING (token))
SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
oracle("template_ranking", "ranked", "SELECT payment_id, CAST(position AS INTEGER) AS position, template_id, cosine, score FROM ranked")
oracle("personalised_messages", "ranked", "SELECT payment_id, channel, amount_band, retrieved_ids, top_similarity, drafted_message, llm_used FROM message_log")
_terms = ("which", "recovered", "insufficient_funds", "payments", "were", "clicked", "the", "rule_engine")
oracle("keyword_hits", "scored audit_seed", f""", u AS (SELECT payment_id, status, failure_category, created_at, NULL::VARCHAR AS action_taken, NULL::VARCHAR AS source FROM scored
  UNION ALL SELECT transaction_id, NULL, NULL, logged_at, action_taken, source FROM audit_seed),
i AS (SELECT *, concat_ws(':', payment_id, action_taken, source, status) AS row_id FROM u),
t AS (SELECT row_id, created_at, lower(concat_ws(' ', payment_id, status, failure_category, action_taken, source, row_id)) AS x FROM i),
h AS (SELECT row_id, created_at, {' + '.join(f"(strpos(x, '{w}') > 0)::INT" for w in _terms)} AS hits FROM t)
SELECT row_id, created_at, hits FROM h WHERE hits > 0 ORDER BY hits DESC, created_at DESC, row_id LIMIT 12""")
ORACLES["dense_neighbours"] = """WITH flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM flat GROUP BY 1, 2), c AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM m),
f AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM flat),
s AS (SELECT vec_id, c.label, sum(x * m) AS s FROM f JOIN c USING (i) GROUP BY 1, 2),
r AS (SELECT vec_id, label, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS position FROM s)
SELECT vec_id, CAST(position AS INTEGER) AS position, label, round(round(s, 9), 5) AS cosine FROM r WHERE position <= 3"""
_wide = """, wide AS (SELECT context, max(a) FILTER (arm = 'control') AS ca, max(b) FILTER (arm = 'control') AS cb, max(n) FILTER (arm = 'control') AS cn,
  max(a) FILTER (arm = 'variant') AS va, max(b) FILTER (arm = 'variant') AS vb, max(n) FILTER (arm = 'variant') AS vn, (SELECT sum(n) FROM post) AS t FROM post GROUP BY 1),
means AS (SELECT *, coalesce(ca / (ca + cb), 0.5) AS cm, coalesce(va / (va + vb), 0.5) AS vm FROM wide)"""
oracle("chosen_arms_ucb", "live", _post + _wide + """
SELECT payment_id, context, CASE WHEN vm + sqrt(2 * ln(t) / greatest(coalesce(vn, 0), 1)) > cm + sqrt(2 * ln(t) / greatest(coalesce(cn, 0), 1)) THEN 'variant' ELSE 'control' END AS chosen_arm
FROM live JOIN means USING (context)""")
oracle("chosen_arms_greedy", "live", _post + _wide + " SELECT payment_id, context, CASE WHEN vm > cm THEN 'variant' ELSE 'control' END AS chosen_arm FROM live JOIN means USING (context)")
oracle("retry_advice", "scored outcomes", f""", mo AS (SELECT {_methods} AS option, {_opt}), wo AS (SELECT {_windows} AS option, {_opt}),
best AS (SELECT option, alpha / (alpha + beta) AS m FROM mo ORDER BY m DESC, list_position({list(METHODS)}, option) LIMIT 1),
timing AS (SELECT option FROM wo ORDER BY round({_upper}, 12) DESC, option LIMIT 1),
p AS (SELECT payment_id, amount_paise, (SELECT option FROM best) AS method, (SELECT option FROM timing) AS minutes,
  greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN score = 0 THEN 0.35::DOUBLE ELSE score END
    + CASE WHEN failure_category IN ('GATEWAY_DOWN', 'NETWORK_TIMEOUT', 'GATEWAY_ERROR') THEN 0.08::DOUBLE ELSE 0 END + ((SELECT m FROM best) - 0.5) * 0.25::DOUBLE)) AS pr FROM scored)
SELECT payment_id, method AS payment_method, minutes AS retry_timing_minutes, CASE WHEN pr > 0.65::DOUBLE THEN 1 ELSE 2 END AS retry_count_advised,
  round(pr, 4) AS expected_success_probability, round(amount_paise / 100.0::DOUBLE * pr, 6) AS expected_revenue FROM p""")

# --- streams: the same result as a batch over all events ---------------------------------------

ORACLES["stream_round_trip"] = "SELECT CAST(event_id AS VARCHAR) AS key, user_id, event_type FROM events"
_CTE["env"] = (
    ("txn",),
    """env AS (SELECT * EXCLUDE (k) REPLACE (CASE WHEN k % 3 <> 0 AND failure_reason IS NOT NULL THEN failure_reason ELSE 'declined at source' END AS failure_reason)
  FROM (SELECT *, CAST(split_part(payment_id, '_', 2) AS BIGINT) AS k FROM txn) WHERE k % 17 <> 0 AND k % 13 <> 0 AND k % 29 <> 0 AND k % 23 <> 0)""",
)
_CTE["env_plan"] = (
    ("env",),
    _CTE["scored"][1].replace("FROM txn", "FROM env") + ",\n"
    + _plan(False).replace("CASE WHEN amount_paise % 3 = 0 THEN 'OFFER_EMI' END AS proposed", "NULL::VARCHAR AS proposed"),
)
oracle("stream_decisions", "env_plan", "SELECT payment_id, merchant_id, amount_paise, failure_category, score, arm, action, final_status, ev_rupees FROM plan")
_CTE["env_decided"] = (("env_plan",), _CTE["decided"][1])
oracle("stream_audit", "env_decided", "SELECT transaction_id, CAST(seq % 8 AS INTEGER) AS step, action_taken, source, decision_rationale FROM decided")
oracle("stream_reviews", "env_plan", """SELECT sha256('review|' || payment_id) AS hitl_id, payment_id AS transaction_id, amount_paise, action AS proposed_action,
  review_reason AS trigger_reason, score AS ml_score, arm AS ab_arm FROM plan WHERE final_status = 'PENDING_APPROVAL'""")
oracle("stream_shadow", "env_plan", """SELECT sha256('shadow|' || payment_id) AS shadow_id, payment_id, merchant_id, arm AS ab_arm, ev_rupees, action AS proposed_action,
  'SHADOW' AS execution_mode FROM plan WHERE gated""")
oracle("stream_decision_retries", "env_plan", """, n AS (SELECT *, CAST(split_part(payment_id, '_', 2) AS BIGINT) % 5 AS fails FROM plan)
SELECT payment_id, CAST(fails AS INTEGER) AS attempt, CASE WHEN fails = 4 THEN 'DEAD' ELSE final_status END AS final_status, CASE WHEN fails < 4 THEN ev_rupees END AS ev_rupees FROM n""")
oracle("dead_letters", "txn", """, k AS (SELECT CAST(split_part(payment_id, '_', 2) AS BIGINT) AS k FROM txn),
r AS (SELECT CASE WHEN k % 17 = 0 THEN 'malformed' WHEN k % 13 = 0 THEN NULL WHEN k % 29 = 0 THEN 'no order_id' WHEN k % 23 = 0 THEN 'amount not positive' END AS reason FROM k)
SELECT reason, 0 AS attempt, count(*) AS n, (SELECT count(reason) FROM r) AS replayable FROM r WHERE reason IS NOT NULL GROUP BY 1""")
oracle("dead_letters_replayed", "txn", """, k AS (SELECT merchant_id, CAST(split_part(payment_id, '_', 2) AS BIGINT) AS k FROM txn),
r AS (SELECT merchant_id, CASE WHEN k % 17 = 0 THEN 'malformed' WHEN k % 13 = 0 THEN NULL WHEN k % 29 = 0 THEN 'no order_id' WHEN k % 23 = 0 THEN 'amount not positive' END AS reason FROM k)
SELECT merchant_id, reason, 1 AS attempt, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2""")
ORACLES["stream_first_seen"] = ORACLES["first_seen_events"]
oracle("stream_minute_counters", "outcomes", "SELECT date_trunc('minute', occurred_at) AS minute, merchant_id, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM outcomes GROUP BY 1, 2")
oracle("stream_failure_bins", "outcomes", "SELECT time_bucket(INTERVAL 5 MINUTE, occurred_at) AS bin_start, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM outcomes GROUP BY 1")
oracle("stream_posteriors", "live", _post + " SELECT arm, context, a AS alpha, b AS beta, n AS pulls, round(a / (a + b), 6) AS mean FROM post")
ORACLES["stream_drift_monitor"] = ORACLES["drift_monitor"]
oracle("provider_health", "outcomes", """, c AS (SELECT CASE strategy WHEN 'retry_now' THEN 'links' WHEN 'retry_15m' THEN 'whatsapp' WHEN 'offer_upi' THEN 'sms' ELSE 'email' END AS channel,
  call_id, occurred_at AS at_time, recovered = 1 AS ok FROM outcomes),
l AS (SELECT *, CASE channel WHEN 'links' THEN 5 WHEN 'email' THEN 5 ELSE 3 END AS lim, CASE channel WHEN 'links' THEN 30 WHEN 'email' THEN 120 ELSE 60 END AS wait,
  sum(ok::INT) OVER (PARTITION BY channel ORDER BY call_id) AS g FROM c),
r AS (SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY channel, g ORDER BY call_id) AS BIGINT) AS run FROM l),
p AS (SELECT *, coalesce(lag(run) OVER w, 0) AS before_run, lag(at_time) OVER w AS before_at FROM r WINDOW w AS (PARTITION BY channel ORDER BY call_id))
SELECT channel, call_id, at_time AS "at", ok, run, CASE WHEN before_run < lim THEN 'CLOSED' WHEN at_time - before_at >= wait * INTERVAL 1 SECOND THEN 'HALF_OPEN' ELSE 'OPEN' END AS state_before,
  CASE WHEN run >= lim THEN 'OPEN' ELSE 'CLOSED' END AS state_after FROM p""")
ORACLES["stream_provider_health"] = ORACLES["provider_health"]
ORACLES["stream_retries"] = """SELECT event_id, CAST(event_id % 5 AS INTEGER) AS attempt, CASE WHEN event_id % 5 = 4 THEN 'dead' ELSE 'done' END AS outcome FROM events"""
