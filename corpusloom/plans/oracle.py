"""SQL that the equivalents of the queries share (DuckDB)."""

from __future__ import annotations

WIDE = "".join(chr(0xFF01 + k) for k in range(94))
NARROW = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def norm(e: str) -> str:
    """The normaliser, for the compatibility forms that the tables hold (full width, fi, fl)."""
    folded = f"translate(replace(replace(coalesce({e}, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{WIDE}', '{NARROW}')"
    spaced = f"regexp_replace(lower({folded}), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({spaced}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def strip(e: str) -> str:
    return f"nullif(regexp_replace({e}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g'), '')"


def visible(e: str) -> str:
    out = f"regexp_replace(coalesce({e}, ''), '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"coalesce({strip(out)}, '')"


_RECORDS = f"""
raw AS (
  SELECT record_id, batch_no, received_at, round_id, team_id, highlight_ratio, fidelity, ordinal, markup_html,
    {strip("coalesce(tag, payload->>'$.tag')")} AS tag, coalesce(body_text, payload->>'$.body_text') AS body,
    {", ".join(f"{strip(c)} AS {c}" for c in ("cite", "fullcite", "source_url", "source_pub_date", "pocket", "hat", "block", "spoken", "external_id"))},
    {visible("markup_html")} AS shown
  FROM card_records),
kinds AS (
  SELECT * EXCLUDE (body), CASE WHEN {strip("body")} IS NOT NULL THEN 'evidence' WHEN tag IS NOT NULL THEN 'analytic'
      WHEN length(shown) >= 40 THEN 'recovered' ELSE 'failed' END AS status, body FROM raw),
mapped AS (
  SELECT * EXCLUDE (body, shown), status = 'analytic' AS is_analytic,
    CASE status WHEN 'evidence' THEN body WHEN 'recovered' THEN shown END AS body_text,
    CASE status WHEN 'failed' THEN NULL WHEN 'analytic' THEN sha256('1:analytic:' || {norm("tag")})
      ELSE sha256('1:' || {norm("CASE status WHEN 'evidence' THEN body ELSE shown END")}) END AS canonical_key
  FROM kinds)"""
_CARDS = """
card AS (
  SELECT canonical_key, min(record_id) AS card_id,
    min(record_id) FILTER (source_url IS NOT NULL) AS u, min(record_id) FILTER (source_pub_date IS NOT NULL) AS d, min(record_id) FILTER (fullcite IS NOT NULL) AS f
  FROM mapped WHERE canonical_key IS NOT NULL GROUP BY 1),
cards2 AS (
  SELECT c.card_id, c.canonical_key, m.tag, m.cite, m.body_text, m.is_analytic, mu.source_url, md.source_pub_date, mf.fullcite,
    coalesce(length(m.body_text), 0) AS body_len
  FROM card c JOIN mapped m ON m.record_id = c.card_id LEFT JOIN mapped mu ON mu.record_id = c.u
    LEFT JOIN mapped md ON md.record_id = c.d LEFT JOIN mapped mf ON mf.record_id = c.f),
variant AS (
  SELECT * FROM (
    SELECT m.*, c.card_id, coalesce('round:' || round_id, 'row:' || record_id) AS document_id,
      row_number() OVER (PARTITION BY coalesce('round:' || round_id, 'row:' || record_id), ordinal, CASE WHEN ordinal IS NULL THEN record_id END ORDER BY record_id) AS rn
    FROM mapped m JOIN card c USING (canonical_key))
  WHERE rn = 1)"""
_DISC = """
round1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY team_id, side NULLS FIRST) AS rn FROM rounds) WHERE rn = 1),
disc AS (
  SELECT v.card_id, v.record_id AS variant_id, v.round_id, v.highlight_ratio, v.block, r.team_id, r.side, r.tournament, r.round_date, r.topic_id,
    t.school_id, t.name AS team_name, t.display_name AS team_display, s.caselist, s.name AS school_name, s.display_name AS school_display, s.state,
    2000 + try_cast(regexp_extract(s.caselist, '(\\d{2})$', 1) AS INT) AS season
  FROM variant v JOIN round1 r ON r.id = v.round_id JOIN teams t ON t.id = r.team_id JOIN schools s ON s.id = t.school_id)"""
_TOTALS = """
total AS (
  SELECT c.*, coalesce(v.n, 0) AS variant_count, coalesce(d.teams, 0) AS team_count, coalesce(d.schools, 0) AS school_count, d.first_season
  FROM cards2 c LEFT JOIN (SELECT card_id, count(*) AS n FROM variant GROUP BY 1) v USING (card_id)
    LEFT JOIN (SELECT card_id, count(DISTINCT team_id) AS teams, count(DISTINCT school_id) AS schools, min(season) AS first_season FROM disc GROUP BY 1) d USING (card_id))"""


def corpus(body: str, upto: str = "total") -> str:
    """``body`` over the derived tables mapped, cards2, variant, round1, disc and total."""
    parts = {"mapped": 1, "variant": 2, "disc": 3, "total": 4}[upto]
    return "WITH " + ",".join([_RECORDS, _CARDS, _DISC, _TOTALS][:parts]) + "\n" + body
