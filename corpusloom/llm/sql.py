"""SQL that says the same as the queries of this package, where SQL can (DuckDB)."""

from __future__ import annotations

WIDE = "".join(chr(0xFF01 + k) for k in range(94))
NARROW = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def _folded(e: str) -> str:
    return f"lower(translate(replace(replace(coalesce({e}, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '{WIDE}', '{NARROW}'))"


def _squeezed(e: str) -> str:
    return f"regexp_replace({_folded(e)}, '[^a-z0-9]', '', 'g')"


def _words(e: str) -> str:
    seen = f"regexp_replace({_folded(e)}, '[\\x{{ad}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    joined = f"regexp_replace({seen}, '([a-z0-9])[-\\x{{2010}}]\\s*\\n\\s*([a-z0-9])', '\\1\\2', 'g')"
    return f"regexp_extract_all({joined}, '[a-z0-9]+')"


_RECORDS = """
rec AS (SELECT record_id, batch_no, ltrim(regexp_extract(external_id, '(\\d+)\\D*$', 1), '0') AS number, coalesce(tag, payload->>'$.tag') AS tag, coalesce(body_text, payload->>'$.body_text') AS body,
  coalesce(is_analytic, lower(payload->>'$.is_analytic') IN ('true', '1'), false) AS kind FROM card_records)"""


def _near(source: str) -> str:
    """CTEs from (id, kind, text): ``near`` (a, b) of different texts that are the same up to
    small edits, by comparing all that share a word, and ``cls`` (id, rep)."""
    return f"""
src AS ({source}), tok AS (SELECT id, kind, {_words('text')} AS w FROM src), doc AS (SELECT * FROM tok WHERE len(w) > 0),
cls AS (SELECT id, min(id) OVER (PARTITION BY kind, w) AS rep FROM doc), rep AS (SELECT d.* FROM doc d JOIN cls USING (id) WHERE cls.rep = d.id),
wc AS (SELECT id, kind, n, x, count(*) AS c FROM (SELECT id, kind, len(w) AS n, unnest(w) AS x FROM rep) GROUP BY ALL),
wp AS (SELECT p.id AS a, q.id AS b FROM wc p JOIN wc q ON p.x = q.x AND p.kind = q.kind AND p.id < q.id AND p.n >= 0.8 * q.n AND q.n >= 0.8 * p.n GROUP BY p.id, q.id, p.n, q.n HAVING sum(least(p.c, q.c)) >= 0.8 * greatest(p.n, q.n)),
bg AS (SELECT id, n, x, count(*) AS c FROM (SELECT id, greatest(len(w) - 1, 1) AS n, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM rep) GROUP BY ALL),
near AS (SELECT wp.a, wp.b FROM wp JOIN bg p ON p.id = wp.a JOIN bg q ON q.id = wp.b AND q.x = p.x GROUP BY wp.a, wp.b, p.n, q.n HAVING sum(least(p.c, q.c)) >= 0.6 * greatest(p.n, q.n))"""


_ADDRESS = r"(?:https?://\S+|no address)"
_LAYOUTS = (
    (rf"^\[[^;,]+, [^;]+; ([^;“”\"]*?); ''[^;]+''; [^;]+; {_ADDRESS}\]", 1),
    (rf"^[^(\"]+ \([^)]+\)\. \"[^\"]+\" [^.\"]+\. ([^;“”\"]*?)\. {_ADDRESS}", 1),
    (rf"^[^,“]+, [^“]+?, ([^;“”\"]*?), “[^”]+” [^,”]+, {_ADDRESS}", 1),
    (rf"^[^–]+ – [^–]+ – [^–]+, ([^;–“”\"]*?) – [^–]+ – {_ADDRESS}", 1),
)
_CITE = "trim(regexp_replace(fullcite, '\\s+', ' ', 'g'))"
_COMPLETE = " OR ".join(f"regexp_matches(regexp_extract({_CITE}, '{p}', {g}), '\\d')" for p, g in _LAYOUTS)
_SHOWN = "regexp_replace(markup_html, '<[^>]*>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _SHOWN = f"replace({_SHOWN}, '{_a}', '{_b}')"
_TRUST = "CASE fidelity WHEN 'opensource' THEN 4 WHEN 'pdf' THEN 3 WHEN 'private' THEN 2 WHEN 'cites_only' THEN 1 ELSE 0 END"


def _pick(field: str, usable: str, trust: str) -> str:
    return f"SELECT canonical_key, '{field}' AS field, arg_min(id, (-({trust}), (updated_at IS NULL)::INT, -epoch_us(updated_at), id)) AS id FROM cards WHERE {usable} AND canonical_key IN (SELECT canonical_key FROM cards GROUP BY 1 HAVING count(*) > 1) GROUP BY 1"


SQL = {
    "p1_found": " UNION ALL ".join([
        _pick("markup_html", f"{_squeezed('body_text')} <> '' AND contains({_squeezed(_SHOWN)}, {_squeezed('body_text')})", _TRUST),
        _pick("fullcite", f"coalesce({_COMPLETE}, false)", _TRUST),
        _pick("team_count", "team_count BETWEEN 1 AND variant_count", "0"),
    ]),
    "p2_found": f"""WITH {_near("SELECT id, coalesce(is_analytic, false) AS kind, CASE WHEN coalesce(is_analytic, false) THEN tag ELSE body_text END AS text FROM cards")},
lnk AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT rep, rep FROM cls)
SELECT p.id AS id_a, q.id AS id_b FROM lnk JOIN cls p ON p.rep = lnk.a JOIN cls q ON q.rep = lnk.b JOIN cards c ON c.id = p.id JOIN cards d ON d.id = q.id WHERE p.id < q.id AND c.canonical_key <> d.canonical_key""",
    "p4_found": """WITH RECURSIVE bk AS (SELECT card_id, lower(trim(bucket_id)) AS k FROM hf_buckets WHERE trim(bucket_id) <> '' AND card_id IS NOT NULL),
edge AS (SELECT card_id AS a, min(card_id) OVER (PARTITION BY k) AS b FROM bk UNION SELECT card_id_a, card_id_b FROM dedup_pairs WHERE merged AND card_id_a IS NOT NULL AND card_id_b IS NOT NULL),
twoway AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(x, y) AS (SELECT a, a FROM twoway UNION SELECT r.x, e.b FROM reach r JOIN twoway e ON e.a = r.y)
SELECT min(y) AS group_id, x AS card_id FROM reach GROUP BY x""",
    "p5_found": f"""WITH RECURSIVE {_RECORDS}, {_near("SELECT record_id AS id, kind, CASE WHEN kind THEN tag ELSE body END AS text FROM rec")},
edge AS (SELECT a, b FROM near UNION SELECT id, rep FROM cls UNION SELECT record_id, min(record_id) OVER (PARTITION BY number) FROM rec WHERE number <> ''),
twoway AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(x, y) AS (SELECT a, a FROM twoway UNION SELECT r.x, e.b FROM reach r JOIN twoway e ON e.a = r.y),
lab AS (SELECT x, min(y) AS g FROM reach GROUP BY x)
SELECT g AS first_id, x AS record_id FROM lab JOIN rec r ON r.record_id = x JOIN rec f ON f.record_id = g WHERE f.batch_no < r.batch_no""",
    "p6_found": f"""WITH {_RECORDS}, k AS (SELECT record_id, {_squeezed('tag')} AS t, {_squeezed('body')} AS b, kind FROM rec)
SELECT min(record_id) AS first_id, count(*) AS n_copies FROM k WHERE t <> '' OR b <> '' GROUP BY t, b, kind HAVING count(*) > 1""",
}
