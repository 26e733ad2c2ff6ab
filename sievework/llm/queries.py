"""Queries of the training-data problems, and their SQL where SQL can say the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.values import MISSING
from sievework.llm import cube, defects, groupsplit, mixing, nearjoin, overlap, packing, spans, visual
from sievework.operators.evalgrid import text_of

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[..., DataFrame], *tables: str, **options) -> Query:
    """The query that applies an operator to whole tables."""
    return lambda spark, sf: operator(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in tables), **options)


QUERIES: dict[str, Query] = {
    "p1_found": _on(overlap.found, "train_records"),
    "p1_overlap_report": _on(overlap.report, "train_records"),
    "p2_found": _on(defects.found, "train_records"),
    "p2_defect_report": _on(defects.report, "train_records"),
    "p3_found": _on(groupsplit.found, "split_rows"),
    "p3_forest": _on(groupsplit.forest_edges, "split_rows"),
    "p3_splits": _on(groupsplit.split, "split_rows", "split_targets"),
    "p3_kept_together": _on(groupsplit.kept_together, "split_rows", "split_targets"),
    "p3_split_report": _on(groupsplit.split_report, "split_rows", "split_targets"),
    "p4_found": _on(nearjoin.found, "train_records"),
    "p4_groups": _on(nearjoin.groups, "train_records"),
    "p5_found": _on(cube.found, "split_rows", "sample_targets"),
    "p5_sample": _on(cube.draw_sample, "split_rows", "sample_targets"),
    "p5_target_report": _on(cube.report, "split_rows", "sample_targets"),
    "p5_reachability": _on(cube.reachability, "split_rows", "sample_targets"),
    "p6_found": _on(visual.found, "train_records", "predictions"),
    "p6_message_forms": _on(visual.train_forms, "train_records"),
    "p6_letter_forms": _on(lambda p: visual.letter_forms(p).withColumn("forms", text_of(F.col("forms"))), "predictions"),
    "p7_containers": _on(packing.packed, "documents", "pack_limits"),
    "p7_packing_report": _on(packing.report, "documents", "pack_limits"),
    "p7_facts": _on(packing.facts, "documents", "pack_limits"),
    "p8_mix": _on(mixing.mixed, "documents", "mix_targets"),
    "p8_share_report": _on(mixing.report, "documents", "mix_targets"),
    "p8_caps": _on(mixing.caps, "documents", "mix_targets"),
    "p9_found": _on(spans.found, "documents"),
    "p9_shared_report": _on(spans.report, "documents"),
}

_MISSING = ", ".join(f"'{m}'" for m in MISSING)
_BLANK = r"[\s\p{Z}\x{200B}\x{FEFF}]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _plain(x: str) -> str:
    return _strip(f"translate({x}, '{_WIDE}', '{_NARROW}')")


def _category(x: str) -> str:
    return f"CASE WHEN lower({_plain(x)}) NOT IN ({_MISSING}) THEN upper({_plain(x)}) END"


def _letter_set(x: str) -> str:
    letters = f"list_transform({x}, lambda v: upper({_plain('v')}))"
    return f"nullif(array_to_string(list_sort(list_distinct(list_filter({letters}, lambda v: regexp_full_match(v, '[A-Z]')))), ','), '')"


def _relation(column: str) -> str:
    v = f"lower({_strip(column)})"
    known = f"{v} NOT IN ({_MISSING}) AND NOT regexp_full_match({v}, '([a-z]+[_/:-])?0+')"
    return f"SELECT split_row_id AS id, '{column}' AS f, {v} AS v FROM split_rows WHERE {known}"


#: Compatibility forms of single characters, for SQL engines without NFKC; the table is built from Unicode data.
_FORMS = {
    chr(c): f
    for c in range(0xA0, 0x10000)
    if not 0xD800 <= c < 0xE000 and len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c) and f.isalnum()
}
_NORMAL = "regexp_replace(lower(translate(nfc_normalize({x}), '%s', '%s')), '[^\\p{{L}}\\p{{N}}]', '', 'g')" % ("".join(_FORMS), "".join(_FORMS.values()))
_USER = "list_filter(messages, lambda m: m.role = 'user')[-1].content"
_STORY = f"""CASE WHEN regexp_matches({_USER}, '(故事|Story)[：:]') THEN regexp_replace(regexp_extract({_USER}, '(?s)^.*?(?:故事|Story)[：:](.*)$', 1), '(?s)^(.*)(?:选项|Options)[：:].*$', '\\1') END"""


def _pairs(text: str, threshold: float, keep: str) -> str:
    """All pairs of rows whose sets of 5-character pieces are similar, by counting common pieces."""
    return f"""WITH r AS (SELECT _source_line AS line, split_name, {_NORMAL.format(x=text)} AS x FROM train_records), t AS (SELECT x, row_number() OVER (ORDER BY x) AS id FROM (SELECT DISTINCT x FROM r WHERE x <> '')),
s AS (SELECT DISTINCT id, substr(x, i, 5) AS p FROM (SELECT id, x, unnest(range(1, greatest(2, length(x) - 3))) AS i FROM t)), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.id < b.id GROUP BY ALL),
near AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= {threshold} * (x.n + y.n - c) UNION ALL SELECT id, id FROM t), l AS (SELECT line, split_name, id FROM r JOIN t USING (x))
SELECT DISTINCT least(u.line, v.line) AS line_a, greatest(u.line, v.line) AS line_b FROM near JOIN l u ON u.id = a JOIN l v ON v.id = b WHERE u.line <> v.line AND {keep}"""


#: Letters written with other characters, and what they stand for: look-alikes, and compatibility forms by Unicode data.
_LETTER_FORMS = {
    chr(c): f for c in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)) if "A" <= (f := unicodedata.normalize("NFKC", chr(c)).upper()) <= "Z" and len(f) == 1
} | {k: v.upper() for k, v in visual.FOREIGN.items() if len(v) == 1}
_UNSEEN = "[" + "".join(rf"\x{{{ord(a):X}}}-\x{{{ord(b):X}}}" for a, b in visual._runs(visual.INVISIBLE)) + "]"
_BLANKS = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}]"

#: Every window of 150 characters, those of two documents, and their union per document.
_SHARED = """w AS (SELECT doc_id, i, hash(substr(text, i + 1, 150)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), c AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM s)),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 150 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n),
spans AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 150 - min(i))::BIGINT AS span_chars FROM g GROUP BY doc_id, island)"""

#: Rows that reach each other over common values.
_GROUPS = f"""RECURSIVE r AS ({' UNION ALL '.join(map(_relation, groupsplit.RELATIONS))}),
s AS (SELECT f, v, min(id) AS lo FROM r GROUP BY f, v HAVING count(DISTINCT id) > 1),
star AS (SELECT DISTINCT id, lo FROM r JOIN s USING (f, v) WHERE id <> lo),
e AS (SELECT id AS a, lo AS b FROM star UNION SELECT lo, id FROM star),
reach AS (SELECT DISTINCT a AS start, a AS node FROM e UNION SELECT start, b FROM reach JOIN e ON node = a)"""
#: Distinct samples per value of a field, the sample's size, and the targets in one spelling.
_REACH = f"""p AS (SELECT nullif({_strip('sample_id')}, '') AS sample_id, {_category('question_type')} AS question_type, {_category('dimension')} AS dimension,
{_letter_set('gold_letters')} AS gold_letters FROM split_rows), k AS (SELECT * FROM p WHERE sample_id IS NOT NULL),
v AS (SELECT sample_id, 'question_type' AS f, question_type AS x FROM k UNION ALL SELECT sample_id, 'dimension', dimension FROM k UNION ALL SELECT sample_id, 'gold_letters', gold_letters FROM k),
c AS (SELECT f, x, count(DISTINCT sample_id) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL), z AS (SELECT count(DISTINCT sample_id) // 10 AS size FROM k),
t AS (SELECT target_id, field_name AS f, CASE WHEN field_name = 'gold_letters' THEN {_letter_set("string_split(field_value, ',')")} ELSE {_category('field_value')} END AS x, target_permille, min_rows FROM sample_targets)"""

_PAIRS_1 = _pairs(_STORY, overlap.THRESHOLD, "(u.split_name = 'train') <> (v.split_name = 'train') AND u.split_name IN ('train', 'dev', 'test') AND v.split_name IN ('train', 'dev', 'test')")
_PAIRS_4 = _pairs(_USER, nearjoin.THRESHOLD, "true")

ORACLE: dict[str, str] = {
    "p1_found": _PAIRS_1,
    "p4_found": _PAIRS_4,
    "p3_found": f"""WITH {_GROUPS} SELECT start AS split_row_id, min(node) AS group_row_id FROM reach GROUP BY start""",
    "p3_kept_together": f"""WITH {_GROUPS}, g AS (SELECT start, min(node) AS root FROM reach GROUP BY start)
SELECT (SELECT count(*) FROM split_rows) AS rows, (SELECT count(*) FROM split_rows) - (SELECT count(*) FROM g) + (SELECT count(DISTINCT root) FROM g) AS groups, 0 AS unassigned, 0 AS divided_groups""",
    "p5_found": f"""WITH {_REACH} SELECT target_id FROM t LEFT JOIN c USING (f, x), z WHERE coalesce(n, 0) < min_rows OR coalesce(n, 0) * 1000 < target_permille * size""",
    "p5_reachability": f"""WITH {_REACH} SELECT target_id, coalesce(n, 0) AS available, size AS sample_size, coalesce(n, 0) >= min_rows AND coalesce(n, 0) * 1000 >= target_permille * size AS can_be_met
FROM t LEFT JOIN c USING (f, x), z""",
    "p6_letter_forms": f"""WITH l AS (SELECT prediction_id AS row_id, predicted_letters AS p, list_transform(predicted_letters, lambda v: upper(trim(translate(regexp_replace(regexp_replace(v, '{_UNSEEN}', '', 'g'),
'{_BLANKS}', ' ', 'g'), '{"".join(_LETTER_FORMS)}', '{"".join(_LETTER_FORMS.values())}')))) AS f FROM predictions)
SELECT row_id, CASE WHEN p IS NULL THEN '<unparsed>' ELSE '[' || array_to_string(f, ',') || ']' END AS forms,
coalesce(len(list_filter(p, lambda v: regexp_matches(v, '{_UNSEEN}|{_BLANKS}|[{"".join(_LETTER_FORMS)}]'))) > 0, false) AS changed FROM l""",
    "p7_facts": """SELECT container_kind, count(*) AS documents, 0 AS needlessly_cut, 0 AS wrongly_cut, 0 AS overfull_containers FROM documents, pack_limits WHERE length(text) > 0 GROUP BY container_kind""",
    "p1_overlap_report": f"""WITH pairs AS ({_PAIRS_1}), e AS (SELECT _source_line AS line, split_name, source FROM train_records WHERE split_name IN ('dev', 'test')), b AS (SELECT line_a, line_b FROM pairs UNION ALL SELECT line_b, line_a FROM pairs),
x AS (SELECT _source_line AS line, {_NORMAL.format(x=_STORY)} AS x FROM train_records), h AS (SELECT e.line, count(*) AS pairs, max(CASE WHEN v.x = w.x THEN 1 ELSE 0 END) AS equal FROM e JOIN b ON b.line_a = e.line JOIN x v ON v.line = b.line_a JOIN x w ON w.line = b.line_b GROUP BY e.line)
SELECT split_name, source, count(*) AS eval_rows, count(pairs) AS overlapping_rows, count(*) FILTER (equal = 1) AS equal_rows, coalesce(sum(pairs), 0)::BIGINT AS pairs, round(count(pairs) / count(*), 6) AS overlapping_share
FROM e LEFT JOIN h USING (line) GROUP BY split_name, source""",
    "p4_groups": f"""WITH RECURSIVE pairs AS ({_PAIRS_4}), both_ways AS (SELECT line_a AS a, line_b AS b FROM pairs UNION ALL SELECT line_b, line_a FROM pairs),
x AS (SELECT _source_line AS line, {_NORMAL.format(x=_USER)} AS x FROM train_records), reach AS (SELECT _source_line AS start, _source_line AS node FROM train_records UNION SELECT start, b FROM reach JOIN both_ways ON node = a),
g AS (SELECT start, min(node) AS root FROM reach GROUP BY start), n AS (SELECT root, count(*) AS n FROM g GROUP BY root),
l AS (SELECT a, count(DISTINCT w.x) AS links FROM both_ways JOIN x v ON v.line = a JOIN x w ON w.line = b WHERE v.x <> w.x GROUP BY a)
SELECT start AS source_line, g.root AS group_line, n AS group_rows, coalesce(links, 0) AS links FROM g JOIN n ON n.root = g.root LEFT JOIN l ON a = start""",
    "p8_caps": f"""SELECT replace(lower({_strip('source')}), '-', '_') AS source, sum(target_permille)::BIGINT AS target_permille, max(max_repeats) AS max_repeats, true AS kept
FROM mix_targets WHERE target_permille > 0 AND max_repeats > 0 GROUP BY 1""",
    "p9_found": f"""WITH {_SHARED} SELECT doc_id, span_start, span_chars FROM spans""",
    "p9_shared_report": f"""WITH {_SHARED}, d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS chars FROM documents GROUP BY doc_id),
p AS (SELECT doc_id, sum(span_chars)::BIGINT AS shared_chars, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(p.spans, 0) AS spans, CASE WHEN chars > 0 THEN round(coalesce(shared_chars, 0) / chars, 6) ELSE 0.0 END AS shared_share
FROM d LEFT JOIN p ON d.doc_id = p.doc_id""",
}
