"""SQL for DuckDB that gives the rows of each registered query, written apart from the DataFrame code."""

from __future__ import annotations

import json

from groundloom.config import STOPWORDS
from groundloom.functions.text import EDGES
from groundloom.operators import tuning
from groundloom.operators.extract import extraction_params
from groundloom.queries import CONFIG


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'), {_quoted(EDGES)}), '^(a|an|the) ', '')"


def _words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z0-9]+'), lambda t: length(t) >= 4)"


def _firsts(w: str) -> str:
    return f"list_filter({w}, lambda t, i: list_position({w}, t) = i)[1:12]"


def _has(longer: str, shorter: str) -> str:
    exact = rf"regexp_matches({longer}, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape({shorter}) || '([^\p{{L}}\p{{N}}_]|$)')"
    return f"CASE WHEN {shorter} <> '' AND contains({longer}, {shorter}) THEN {exact} ELSE false END"


_STOP = "(" + ", ".join(map(_quoted, STOPWORDS)) + ")"


def _part(v: str, w: str) -> str:
    one = lambda a, b: f"(length({a}) >= 2 AND {a} NOT IN {_STOP} AND {_has(b, a)})"
    return f"CASE WHEN length({v}) <= length({w}) THEN {one(v, w)} ELSE {one(w, v)} END"


def _letters(x: str) -> str:
    return f"list_transform(range(97, 123), lambda i: (length({x}) - length(replace({x}, chr(i::INT), '')))::DOUBLE)"


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_inner_product({x}, {y})"
    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)} * {dot(b, b)}), 0))"


def _pair(v: str, w: str, vl: str, wl: str) -> str:
    return f"CASE WHEN {v} = {w} THEN true WHEN {_part(v, w)} THEN true ELSE coalesce({_cos(vl, wl)} >= 0.9::DOUBLE, false) END"


def _strength(v: str, w: str, vl: str, wl: str) -> str:
    return f"CASE WHEN {v} = {w} THEN 2.0::DOUBLE WHEN {_part(v, w)} THEN 2.0::DOUBLE ELSE coalesce({_cos(vl, wl)}, -1.0::DOUBLE) END"


_CFI = "CASE WHEN rp IS NULL THEN eg ELSE {a} * eg + (1.0::DOUBLE - {a}) * rp END"

#: Common table expressions and what each needs.
_CTES: dict[str, str] = {
    "inst": """
      SELECT d.doc_id::VARCHAR AS response_id, d.doc_id::VARCHAR AS source_id, d.lang AS task, d.source AS gen_model,
        CASE WHEN substring(md5(d.doc_id::VARCHAR), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split,
        substring(text, 1, length(text) // 2) AS context, nullif(string_split(text, chr(10))[1], '') AS query,
        substring(text, length(text) // 2 + 1) AS response, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS y
      FROM documents d JOIN labels l USING (doc_id)""",
    "picked": "SELECT * FROM inst",
    "toks": f"""
      SELECT response_id, source_id, {_firsts("wa")} AS a, {_firsts("wc")} AS c, {_firsts("wq")} AS q FROM (
        SELECT response_id, source_id, {_words("response")} AS wa, {_words("context")} AS wc, {_words("query")} AS wq FROM picked)""",
    "names": f"""
      SELECT response_id, source_id, raw, {_norm("raw")} AS v FROM (
        SELECT DISTINCT response_id, source_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS raw FROM toks)""",
    "edges": f"""
      SELECT response_id, source_id, {_norm("a[i]")} AS s, {_norm("'co_occurs_with'")} AS r, {_norm("a[i + 1]")} AS o
      FROM (SELECT *, unnest(range(1, len(a))) AS i FROM toks)""",
    "refs": f"""
      SELECT DISTINCT source_id, w FROM (SELECT source_id, {_norm("e")} AS w FROM (SELECT source_id, unnest(list_concat(c, q)) AS e FROM toks)) WHERE w <> ''""",
    "reft": f"""
      SELECT DISTINCT source_id, {_norm("g[i]")} AS s2, {_norm("'co_occurs_with'")} AS r2, {_norm("g[i + 1]")} AS o2
      FROM (SELECT source_id, g, unnest(range(1, len(g))) AS i FROM (SELECT source_id, c AS g FROM toks UNION ALL SELECT source_id, q FROM toks))""",
    "wanted": f"""
      SELECT DISTINCT source_id, v FROM (SELECT source_id, v FROM names UNION ALL SELECT source_id, {_norm("s")} FROM edges UNION ALL SELECT source_id, {_norm("o")} FROM edges) WHERE v <> ''""",
    "pairs": f"""
      SELECT n.source_id, v, w, CASE WHEN v = w THEN 1 WHEN {_part("v", "w")} THEN 2 ELSE 3 END AS kind, {_cos("vl", "wl")} AS cos
      FROM (SELECT *, {_letters("v")} AS vl FROM wanted) n JOIN (SELECT *, {_letters("w")} AS wl FROM refs) r USING (source_id)""",
    "matched": """
      SELECT source_id, v, w AS ref, CASE kind WHEN 1 THEN 'exact' WHEN 2 THEN 'substring' ELSE 'embedding' END AS method FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id, v ORDER BY kind, CASE WHEN kind = 3 THEN -cos ELSE 0 END, w) AS k FROM pairs WHERE kind < 3 OR cos >= 0.9::DOUBLE)
      WHERE k = 1""",
    "ends": f"SELECT DISTINCT source_id, s, r, o, {_letters('s')} AS sl, {_letters('o')} AS ol, {_norm('s')} AS sn, {_norm('o')} AS onn FROM edges",
    "reftl": f"SELECT *, {_letters('s2')} AS s2l, {_letters('o2')} AS o2l FROM reft",
    "tried": f"""
      SELECT e.source_id, s, r, o, s2, r2, o2, CASE WHEN {_pair("s", "s2", "sl", "s2l")} AND {_pair("o", "o2", "ol", "o2l")} THEN 'forward' WHEN {_pair("s", "o2", "sl", "o2l")} AND {_pair("o", "s2", "ol", "s2l")} THEN 'inverse' END AS way
      FROM ends e JOIN reftl t ON t.source_id = e.source_id AND t.r2 = e.r
      WHERE EXISTS (SELECT 1 FROM matched m WHERE m.source_id = e.source_id AND m.v = e.sn) AND EXISTS (SELECT 1 FROM matched m WHERE m.source_id = e.source_id AND m.v = e.onn)""",
    "aligned": """
      SELECT source_id, s, r, o, s2, r2, o2, way AS method FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id, s, r, o ORDER BY s2, r2, o2) AS k FROM tried WHERE way = 'forward') WHERE k = 1""",
    "scored": """
      SELECT t.response_id, t.source_id, len(c)::INT AS Vc, greatest(len(c) - 1, 0)::INT AS Ec, len(q)::INT AS Vq, greatest(len(q) - 1, 0)::INT AS Eq,
        coalesce(n.va, 0)::INT AS Va, greatest(len(a) - 1, 0)::INT AS Ea, n.grounded::DOUBLE / nullif(n.va, 0) AS eg, x.supported::DOUBLE / nullif(len(a) - 1, 0) AS rp,
        coalesce(n.va, 0) = 0 AS unscorable, NOT EXISTS (SELECT 1 FROM refs r WHERE r.source_id = t.source_id) AS ref_empty
      FROM toks t
      LEFT JOIN (SELECT response_id, count(*) AS va, count(m.ref) AS grounded FROM names n LEFT JOIN matched m USING (source_id, v) GROUP BY response_id) n USING (response_id)
      LEFT JOIN (SELECT response_id, count(a.method) AS supported FROM edges e LEFT JOIN aligned a USING (source_id, s, r, o) GROUP BY response_id) x USING (response_id)""",
    "rows_": f"""
      SELECT s.*, task, gen_model, split, y, length(context)::INT AS context_len, {_CFI.format(a="0.7::DOUBLE")} AS cfi, 1.0::DOUBLE - ({_CFI.format(a="0.7::DOUBLE")}) AS h,
        1.0::DOUBLE - eg AS h_eg, 1.0::DOUBLE - rp AS h_rp
      FROM scored s JOIN inst USING (response_id)""",
}
_TO_MATCHED = ("inst", "picked", "toks", "names", "edges", "refs", "reft", "wanted", "pairs", "matched")
_TO_TRIED = (*_TO_MATCHED, "ends", "reftl", "tried")
_TO_ROWS = (*_TO_TRIED, "aligned", "scored", "rows_")


def _with(ctes: tuple[str, ...], body: str, **other: str) -> str:
    return "WITH " + ",\n".join(f"{c} AS ({other.get(c, _CTES.get(c))})" for c in (*ctes, *(k for k in other if k not in ctes))) + "\n" + body


def _auc(source: str, group: str) -> str:
    g = group + "," if group else ""
    by = f"PARTITION BY {group}" if group else ""
    return f"""
      SELECT {g} count(*) AS n, sum(y)::BIGINT AS n_pos, sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0 AS u,
        (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
      FROM (SELECT *, rank() OVER ({by} ORDER BY h) + (count(*) OVER (PARTITION BY {g} h) - 1) / 2.0 AS rk FROM {source} WHERE h IS NOT NULL)
      {f"GROUP BY {group}" if group else ""}"""


def _auc_out(source: str, group: str, u: bool = True) -> str:
    return f"SELECT {group}, n, n_pos, {'coalesce(u, 0)::DOUBLE AS u,' if u else ''} auc::DOUBLE AS auc FROM ({_auc(source, group)})"


def _overall(key: str) -> str:
    return f"(SELECT *, {key} AS grp FROM rows_ WHERE {key} IS NOT NULL UNION ALL SELECT *, 'OVERALL' FROM rows_)"


_DOC_GRAPHS = f"SELECT doc_id, {_firsts('w')} AS e FROM (SELECT doc_id, {_words('text')} AS w FROM documents)"
_PARAMS = _quoted(json.dumps(extraction_params(CONFIG.extract), sort_keys=True))
_KEY = rf"sha256({_PARAMS} || chr(0) || regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))"
_RAW_AUDIT = """
SELECT t.response_id,
  coalesce((SELECT string_agg(m.v || '>' || m.ref || '>' || m.method, '|' ORDER BY n.raw) FROM names n JOIN matched m USING (source_id, v) WHERE n.response_id = t.response_id), '') AS matched,
  coalesce((SELECT string_agg(n.v, '|' ORDER BY n.raw) FROM names n LEFT JOIN matched m USING (source_id, v) WHERE n.response_id = t.response_id AND m.ref IS NULL), '') AS ungrounded,
  coalesce((SELECT string_agg(e.s || '>' || e.r || '>' || e.o, '|' ORDER BY e.s, e.r, e.o) FROM edges e JOIN aligned a USING (source_id, s, r, o) WHERE e.response_id = t.response_id), '') AS supported,
  coalesce((SELECT string_agg(e.s || '>' || e.r || '>' || e.o, '|' ORDER BY e.s, e.r, e.o) FROM edges e LEFT JOIN aligned a USING (source_id, s, r, o) WHERE e.response_id = t.response_id AND a.method IS NULL), '') AS unsupported
FROM toks t"""


def _grid(values: tuple[float, ...], name: str) -> str:
    return f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {name})"


def _alpha_cv() -> str:
    return _with(
        _TO_ROWS,
        """SELECT alpha, round(cv_auc, 9) AS cv_auc, (SELECT alpha FROM cv ORDER BY cv_auc DESC NULLS LAST, alpha LIMIT 1) AS best_alpha FROM cv""",
        train="SELECT * FROM rows_ WHERE split = 'train' AND NOT unscorable",
        k="SELECT greatest(least(5, CASE WHEN count(*) = 2 THEN min(c) ELSE 0 END), 1) AS k FROM (SELECT y, count(*) AS c FROM train GROUP BY y)",
        dealt="SELECT t.* EXCLUDE (h), (row_number() OVER (PARTITION BY y ORDER BY md5('fold:' || response_id)) - 1) % k AS fold FROM train t, k",
        each=f"SELECT alpha, fold, y, 1.0::DOUBLE - ({_CFI.format(a='alpha')}) AS h FROM dealt, {_grid(CONFIG.evaluate.alpha_grid, 'alpha')}",
        cv=f"SELECT alpha, avg(auc::DOUBLE) AS cv_auc FROM ({_auc('each', 'alpha, fold')}) GROUP BY alpha",
    )


def _tau_sweep() -> str:
    c = CONFIG.evaluate
    return _with(
        ("inst", "picked", "toks", "names", "edges", "refs", "reft"),
        "SELECT tau_e, tau_r, n, auc::DOUBLE AS auc FROM (" + _auc("final", "tau_e, tau_r") + ")",
        picked=f"SELECT * FROM inst WHERE split = 'train'",
        best=f"SELECT response_id, raw, v, max({_strength('v', 'w', 'vl', 'wl')}) FILTER (WHERE w IS NOT NULL AND v <> '') AS best FROM (SELECT *, {_letters('v')} AS vl FROM names) LEFT JOIN (SELECT *, {_letters('w')} AS wl FROM refs) USING (source_id) GROUP BY response_id, raw, v",
        grid=f"SELECT * FROM {_grid(c.sweep_entity, 'tau_e')}, {_grid(c.sweep_relation, 'tau_r')}",
        egs="SELECT response_id, tau_e, tau_r, avg(CASE WHEN best >= tau_e THEN 1.0::DOUBLE ELSE 0 END) AS eg FROM best, grid GROUP BY ALL",
        cand=f"""SELECT e.response_id, e.s, e.r, e.o, least({_strength('e.s', 's2', 'sl', 's2l')}, {_strength('e.o', 'o2', 'ol', 'o2l')}) AS ends, CASE WHEN r = r2 THEN 2.0::DOUBLE ELSE {_cos(_letters('r'), _letters('r2'))} END AS rel,
          (SELECT max(best) FROM best b WHERE b.response_id = e.response_id AND b.v = e.s) AS bs, (SELECT max(best) FROM best b WHERE b.response_id = e.response_id AND b.v = e.o) AS bo
          FROM (SELECT *, {_letters('s')} AS sl, {_letters('o')} AS ol FROM edges) e JOIN (SELECT *, {_letters('s2')} AS s2l, {_letters('o2')} AS o2l FROM reft) t USING (source_id)""",
        per_edge="""SELECT e.response_id, e.s, e.r, e.o, tau_e, tau_r,
          max(CASE WHEN c.ends >= tau_e AND c.rel >= tau_r AND c.bs >= tau_e AND c.bo >= tau_e THEN 1.0::DOUBLE ELSE 0 END) AS held
          FROM edges e CROSS JOIN grid LEFT JOIN cand c USING (response_id, s, r, o) GROUP BY ALL""",
        rps="SELECT response_id, tau_e, tau_r, avg(held) AS rp FROM per_edge GROUP BY ALL",
        final=f"SELECT g.tau_e, g.tau_r, p.y, 1.0::DOUBLE - ({_CFI.format(a='0.7::DOUBLE')}) AS h FROM egs g LEFT JOIN rps USING (response_id, tau_e, tau_r) JOIN picked p USING (response_id)",
    )


def _bootstrap() -> str:
    c = CONFIG.evaluate
    steps, normal = tuning.poisson_steps(), tuning.normal_steps()
    return _with(
        _TO_ROWS,
        """SELECT metric, count(*) AS n, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (
          SELECT 'auc' AS metric, auc AS v FROM per UNION ALL SELECT 'f1', f1 FROM per) GROUP BY metric""",
        counted="SELECT h, y, count(*) AS n, min(response_id) AS first FROM rows_ WHERE split = 'test' AND h IS NOT NULL GROUP BY h, y",
        keyed=f"SELECT *, ('0x' || md5({_quoted(str(c.seed))} || chr(58) || rep || chr(58) || first)[1:8])::BIGINT AS u FROM counted, range({c.bootstrap_replicates}) t(rep)",
        drawn=f"""SELECT rep, h, y, (CASE WHEN n < {len(steps)} THEN len(list_filter(({steps})[least(n, {len(steps) - 1}) + 1], lambda p: u >= p))
          ELSE greatest(floor(n + sqrt(n::DOUBLE) * ({normal}::DOUBLE[])[(u >> 22) + 1] + 0.5::DOUBLE), 0) END)::BIGINT AS w FROM keyed""",
        steps="SELECT rep, h, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS q FROM drawn GROUP BY rep, h HAVING sum(w) > 0",
        runs="SELECT *, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps",
        per="""SELECT rep, (sum(p * (2 * below + q)) / (2.0 * sum(p) * sum(q)))::DOUBLE AS auc,
          coalesce((2.0 * sum(CASE WHEN h >= 0.5 THEN p END) / nullif(2 * sum(CASE WHEN h >= 0.5 THEN p END) + sum(CASE WHEN h >= 0.5 THEN q END) + sum(CASE WHEN h < 0.5 THEN p ELSE 0 END), 0))::DOUBLE, 0) AS f1
          FROM runs GROUP BY rep HAVING sum(p) > 0 AND sum(q) > 0""",
    )


_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

#: Sources and answers of the written corpus.
_SOURCES = rf"""
  SELECT doc_id::VARCHAR AS source_id, ['QA', 'Data2txt', 'Summary'][doc_id % 3 + 1] AS task, CASE WHEN doc_id % 3 = 2 THEN 'Summarize in ' || lang ELSE '' END AS prompt,
    CASE WHEN doc_id % 3 = 1 THEN concat_ws(chr(10), 'The business is named ' || source || '.', source || ' has language = ' || lang || '.', source || ' has about.chars = ' || n_chars || '.',
      source || ' has about.marks[0] = ' || lang || '.', source || ' has about.marks[1] = ' || source || '.') || chr(10) || chr(10) || 'Customer reviews:' || chr(10) || half ELSE half END AS context,
    CASE WHEN doc_id % 3 = 0 THEN nullif({_TRIM.format(x="string_split(text, chr(10))[1]")}, '') END AS query
  FROM (SELECT *, {_TRIM.format(x="substring(text, 1, length(text) // 2)")} AS half FROM documents)"""
_ANSWERS = """
  SELECT d.doc_id::VARCHAR AS response_id, d.doc_id::VARCHAR AS source_id, source AS gen_model, CASE WHEN substring(md5(d.doc_id::VARCHAR), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split,
    substring(text, length(text) // 2 + 1) AS response, CASE WHEN toxic = 1 THEN 'toxic' END AS t1, quality AS implied, CASE WHEN quality = 0 THEN 'low quality' END AS t2, 'good' AS quality
  FROM documents d JOIN labels l USING (doc_id)
  UNION ALL SELECT 't' || conv_id || '-' || turn, conv_id::VARCHAR, 'unknown', '', text, NULL, NULL, NULL, '' FROM conversations WHERE role = 'assistant'"""
_CORPUS = f"""
  SELECT response_id, source_id, task, gen_model, split, context, query, response, CASE WHEN t1 IS NOT NULL OR t2 IS NOT NULL THEN 1 ELSE 0 END AS y, concat_ws(',', t1, t2) AS types, quality, prompt
  FROM ({_ANSWERS}) a JOIN ({_SOURCES}) s USING (source_id)"""


def _three_words() -> str:
    """Relations from a word over the next to the one after."""
    triple = lambda g: ", ".join(f"{_norm(f'{g}[i + {k}]')} AS {c}" for k, c in enumerate("sro"))
    ref = ", ".join(f"{_norm(f'g[i + {k}]')} AS {c}2" for k, c in enumerate("sro"))
    return _with(
        (*_TO_MATCHED, "ends", "reftl", "tried"),
        """SELECT source_id, s, r, o, s2, r2, o2, way AS method FROM (
          SELECT *, row_number() OVER (PARTITION BY source_id, s, r, o ORDER BY s2, r2, o2) AS k FROM tried WHERE way IS NOT NULL) WHERE k = 1""",
        edges=f"SELECT response_id, source_id, {triple('a')} FROM (SELECT *, unnest(range(1, len(a) - 1)) AS i FROM toks)",
        reft=f"SELECT DISTINCT source_id, {ref} FROM (SELECT source_id, g, unnest(range(1, len(g) - 1)) AS i FROM (SELECT source_id, c AS g FROM toks UNION ALL SELECT source_id, q FROM toks))",
        wanted=f"SELECT DISTINCT source_id, v FROM (SELECT source_id, {_norm('s')} AS v FROM edges UNION ALL SELECT source_id, {_norm('o')} FROM edges) WHERE v <> ''",
        tried=_CTES["tried"].replace("t.r2 = e.r", f"CASE WHEN t.r2 = e.r THEN true ELSE coalesce({_cos(_letters('r'), _letters('r2'))} >= 0.75::DOUBLE, false) END"),
    )


def _tuned() -> str:
    return _with(
        _TO_ROWS,
        """SELECT alpha, round(theta, 9) AS theta, round(f1, 9) AS train_f1 FROM (SELECT alpha, coalesce((h + lag(h) OVER (ORDER BY h)) / 2.0::DOUBLE, h - 1e-9::DOUBLE) AS theta,
          2.0::DOUBLE * sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w + (SELECT sum(p) FROM steps)) AS f1 FROM steps WINDOW w AS (ORDER BY h DESC)) ORDER BY f1 DESC, theta LIMIT 1""",
        chosen=f"SELECT min(best_alpha) AS alpha FROM ({_alpha_cv()})",
        steps=f"SELECT alpha, h, count_if(y = 1) AS p, count_if(y = 0) AS q FROM (SELECT alpha, y, 1.0::DOUBLE - ({_CFI.format(a='alpha')}) AS h FROM rows_, chosen WHERE split = 'train' AND NOT unscorable) GROUP BY alpha, h",
    )


def _summary(prf: str) -> str:
    band = lambda m, c: f"(SELECT {c} FROM bands WHERE metric = '{m}')"
    return _with(
        _TO_ROWS,
        f"""SELECT 0.7::DOUBLE AS alpha, 0.5::DOUBLE AS theta, 0.9::DOUBLE AS tau_e, 0.75::DOUBLE AS tau_r, round((SELECT auc::DOUBLE FROM ({_auc('good', '')})), 6) AS overall_AUC_exclude_unscorable,
          round((SELECT precision FROM at_theta WHERE grp = 1), 6) AS "overall_P", round((SELECT recall FROM at_theta WHERE grp = 1), 6) AS "overall_R", round((SELECT f1 FROM at_theta WHERE grp = 1), 6) AS "overall_F1",
          {band('auc', 'lo')} AS "overall_AUC_lo", {band('auc', 'hi')} AS "overall_AUC_hi", {band('f1', 'lo')} AS "overall_F1_lo", {band('f1', 'hi')} AS "overall_F1_hi",
          round((SELECT auc::DOUBLE FROM ({_auc('filled', '')})), 6) AS "overall_AUC_impute", round((SELECT f1 FROM at_theta WHERE grp = 2), 6) AS "overall_F1_impute",
          count(*) AS degenerate_n, count_if(unscorable)::BIGINT AS degenerate_unscorable, count_if(ref_empty)::BIGINT AS degenerate_ref_empty, count_if(Ea = 0)::BIGINT AS degenerate_no_edges, 0 AS degenerate_failed_extractions
          FROM rows_ WHERE split = 'test'""",
        good="SELECT y, h FROM rows_ WHERE split = 'test' AND NOT unscorable",
        filled="SELECT y, CASE WHEN unscorable THEN 0.5 ELSE h END AS h FROM rows_ WHERE split = 'test'",
        at_theta=prf.format(src="(SELECT *, 1 AS grp FROM good UNION ALL SELECT *, 2 FROM filled)"),
        bands=_bootstrap(),
    )


def oracle_sql() -> dict[str, str]:
    rows = lambda body, **other: _with(_TO_ROWS, body, **other)
    edges = c = CONFIG.evaluate.context_length_edges
    bucket = "CASE " + " ".join(f"WHEN context_len >= {edges[i]} AND context_len < {c[i + 1]} THEN {i}" for i in range(len(c) - 1)) + " END::INT"
    prf = """SELECT grp, tp + fp + fn + tn AS n, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
      SELECT grp, count(*) FILTER (WHERE h >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE h >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE h < 0.5 AND y = 1) AS fn,
        count(*) FILTER (WHERE h < 0.5 AND y = 0) AS tn FROM {src} WHERE h IS NOT NULL GROUP BY grp)"""
    return {
        "fake_entities": f"SELECT doc_id, len(e)::INT AS n, array_to_string(e, '|') AS entities FROM ({_DOC_GRAPHS})",
        "fake_edges": f"SELECT doc_id, (i - 1)::INT AS pos, e[i] AS s, 'co_occurs_with' AS r, e[i + 1] AS o FROM (SELECT *, unnest(range(1, len(e))) AS i FROM ({_DOC_GRAPHS}))",
        "graph_codec": f"""SELECT doc_id, array_to_string(list_sort(e), '|') AS entities,
          array_to_string(list_sort(list_transform(range(1, len(e)), lambda i: e[i] || '>co_occurs_with>' || e[i + 1])), '|') AS relations FROM ({_DOC_GRAPHS})""",
        "build_instances": _with(("inst",), "SELECT *, length(context)::INT AS context_len FROM inst"),
        "split_counts": _with(("inst",), "SELECT split, count(*) AS n FROM inst GROUP BY split"),
        "ref_union": _with(("inst", "picked", "toks", "refs"), "SELECT source_id, w FROM refs"),
        "ref_triples": _with(("inst", "picked", "toks", "reft"), "SELECT source_id, s2, r2, o2 FROM reft"),
        "normalize_lines": f"SELECT doc_id, (i - 1)::INT AS pos, {_norm('l[i]')} AS norm FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
        "cache_keys": f"SELECT doc_id, {_KEY} AS cache_key FROM documents",
        "cache_miss": f"""WITH k AS (SELECT doc_id, text, {_KEY} AS cache_key FROM documents), c AS (SELECT cache_key FROM k SEMI JOIN labels USING (doc_id))
          SELECT cache_key, length(min(text))::INT AS n_chars FROM k ANTI JOIN c USING (cache_key) GROUP BY cache_key""",
        "eg_exact": _with(("inst", "picked", "toks", "names", "refs"), "SELECT response_id, count(*) AS n, count(w) AS matched, count(w)::DOUBLE / count(*) AS eg FROM names n LEFT JOIN refs r ON r.source_id = n.source_id AND r.w = n.v GROUP BY response_id"),
        "match_cascade": _with(_TO_MATCHED, "SELECT source_id, v, ref, method FROM matched", wanted="SELECT DISTINCT source_id, v FROM names WHERE v <> ''"),
        "substring_matches": _with(("inst", "picked", "toks", "names", "refs"), f"SELECT DISTINCT source_id, v, w FROM names JOIN refs USING (source_id) WHERE v <> w AND {_part('v', 'w')}"),
        "rp_align": _with((*_TO_TRIED, "aligned"), "SELECT * FROM aligned"),
        "rp_inverse": _with(_TO_TRIED, """SELECT source_id, s, r, o, s2, r2, o2, way AS method FROM (
          SELECT *, row_number() OVER (PARTITION BY source_id, s, r, o ORDER BY s2, r2, o2) AS k FROM tried WHERE way IS NOT NULL) WHERE k = 1"""),
        "score_rows": rows("SELECT response_id, source_id, task, gen_model, split, y, context_len, Vc, Ec, Vq, Eq, Va, Ea, eg AS EG, rp AS RP, unscorable, ref_empty, cfi AS CFI, h AS H, h_eg AS H_eg, h_rp AS H_rp FROM rows_"),
        "audit_lists": _with((*_TO_TRIED, "aligned"), _RAW_AUDIT),
        "auc_by_task": rows(_auc_out("b", "grp"), b="SELECT * FROM " + _overall("task")),
        "auc_by_model": rows(_auc_out("b", "grp"), b="SELECT * FROM " + _overall("gen_model")),
        "prf_by_task": rows(prf.format(src=_overall("task"))),
        "ablation_auc": rows(_auc_out("b", "score", u=False), b="SELECT * FROM (SELECT y, 'H_eg' AS score, h_eg AS h FROM rows_ UNION ALL SELECT y, 'H_rp', h_rp FROM rows_ UNION ALL SELECT y, 'H', h FROM rows_)"),
        "length_buckets": rows(f"""SELECT m.bucket, mean_len, coalesce(n, 0) AS n, auc::DOUBLE AS auc FROM (SELECT bucket, avg(context_len) AS mean_len FROM b WHERE bucket IS NOT NULL GROUP BY bucket) m
          LEFT JOIN ({_auc('b', 'bucket')}) a ON a.bucket = m.bucket""", b=f"SELECT *, {bucket} AS bucket FROM rows_"),
        "graph_stats": rows(f"""SELECT grp, count(*) AS n, avg(Vc) AS mean_Vc, avg(Ec) AS mean_Ec, avg(Va) AS mean_Va, avg(Ea) AS mean_Ea, avg((Ea = 0)::INT) AS share_no_edges,
          avg(unscorable::INT) AS share_unscorable FROM {_overall('task')} GROUP BY grp"""),
        "mann_whitney": rows(f"""SELECT n_pos AS n1, n - n_pos AS n0, u::DOUBLE AS u, (SELECT median(h) FROM rows_ WHERE y = 1) AS median_1, (SELECT median(h) FROM rows_ WHERE y = 0) AS median_0,
          round((u - n_pos * (n - n_pos) / 2.0 - 0.5) / sqrt(n_pos * (n - n_pos) / 12.0 * (n + 1.0 - (SELECT sum(c * c * c - c)::DOUBLE FROM (SELECT count(*)::DOUBLE AS c FROM rows_ WHERE h IS NOT NULL GROUP BY h)) / (n * (n - 1.0)))), 6)::DOUBLE AS z
          FROM ({_auc('rows_', '')})"""),
        "impute_policy": rows(_auc_out("b", "policy"), b="SELECT y, h, 'exclude' AS policy FROM rows_ WHERE NOT unscorable UNION ALL SELECT y, CASE WHEN unscorable THEN 0.5 ELSE h END, 'impute' FROM rows_"),
        "degenerate": rows("SELECT count(*) AS n, count_if(unscorable)::BIGINT AS unscorable, count_if(ref_empty)::BIGINT AS ref_empty, count_if(Ea = 0)::BIGINT AS no_edges FROM rows_"),
        "theta_f1": rows(
            """SELECT theta, f1 FROM (SELECT h, coalesce((h + lag(h) OVER (ORDER BY h)) / 2.0::DOUBLE, h - 1e-9::DOUBLE) AS theta,
              2.0::DOUBLE * sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w + (SELECT sum(p) FROM steps)) AS f1 FROM steps WINDOW w AS (ORDER BY h DESC)) ORDER BY f1 DESC, theta LIMIT 1""",
            steps="SELECT h, count_if(y = 1) AS p, count_if(y = 0) AS q FROM rows_ WHERE split = 'train' AND h IS NOT NULL GROUP BY h",
        ),
        "alpha_cv": _alpha_cv(),
        "tau_sweep": _tau_sweep(),
        "bootstrap_ci": _bootstrap(),
        "embedding_nn": f"""SELECT query, label, ref, round(cos, 6) AS cos FROM (
          SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY cos DESC, ref) AS k FROM (
            SELECT a.vec_id AS query, a.label, b.vec_id AS ref, round({_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 9) AS cos
            FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE k = 1""",
        "flag_labels": """SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS y_all, CASE WHEN (toxic = 1 AND quality <> 1) OR quality = 0 THEN 1 ELSE 0 END AS y_strict,
          concat_ws(',', CASE WHEN toxic = 1 AND quality <> 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low quality' END) AS types FROM labels""",
        "json_facts": "SELECT event_id, 'The event has props.' || key || ' = ' || coalesce(props ->> ('$.' || key), 'null (unknown)') || '.' AS fact FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
        "dedupe_sources": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
        "first_instances": "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
        "usage_cumsum": """SELECT event_id, (sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER w)::BIGINT AS cum_calls, (sum(CASE WHEN event_type = 'view' THEN 0 ELSE round(value * 100)::BIGINT END) OVER w)::BIGINT AS cum_cost_cents
          FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
        "usage_summary": "SELECT count(*) AS api_calls, sum(round(value * 100)::BIGINT)::BIGINT AS cost_cents FROM events WHERE event_type <> 'view'",
        "sample_n": "SELECT doc_id, source FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 300",
        "prefix_limit": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
        "graph_store": f"""WITH w AS (SELECT doc_id, {_KEY} AS cache_key, {_words('text')} AS w FROM documents), k AS (SELECT doc_id, cache_key, {_firsts('w')} AS e FROM w), own AS (SELECT DISTINCT cache_key FROM k SEMI JOIN labels USING (doc_id))
          SELECT cache_key, greatest(len(any_value(e)) - 1, 0)::INT AS n_relations, array_to_string(CASE WHEN o.cache_key IS NULL THEN any_value(e) ELSE list_prepend('labelled', any_value(e)) END, '|') AS entities
          FROM k LEFT JOIN own o USING (cache_key) GROUP BY cache_key, o.cache_key""",
        "chunked_graphs": rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM documents),
          s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+')) AS sentence, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]+\s*|[^.!?]+'), 1) AS i FROM t),
          p AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS place FROM (
            SELECT doc_id, i, unnest(range(0, (length(sentence) - 1) // 6000 + 1)) AS k, sentence FROM s), LATERAL (SELECT substr(sentence, k * 6000 + 1, 6000) AS piece)),
          laid AS (
            SELECT doc_id, place, 0 AS chunk, length(piece) AS used FROM p WHERE place = 1
            UNION ALL
            SELECT p.doc_id, p.place, CASE WHEN used + length(piece) <= 6000 THEN chunk ELSE chunk + 1 END, CASE WHEN used + length(piece) <= 6000 THEN used + length(piece) ELSE length(piece) END
            FROM laid JOIN p ON p.doc_id = laid.doc_id AND p.place = laid.place + 1),
          c AS (SELECT doc_id, chunk, string_agg(piece, '' ORDER BY place) AS text FROM laid JOIN p USING (doc_id, place) GROUP BY doc_id, chunk),
          e AS (SELECT doc_id, {_firsts('w')} AS e FROM (SELECT doc_id, {_words('text')} AS w FROM c)),
          r AS (SELECT DISTINCT doc_id, a || '>co_occurs_with>' || b AS link, a, b FROM (SELECT doc_id, unnest(list_zip(e[:-2], e[2:])) AS x FROM e WHERE len(e) > 1), LATERAL (SELECT x[1] AS a, x[2] AS b))
          SELECT t.doc_id, (SELECT count(*) FROM c WHERE c.doc_id = t.doc_id)::INT AS n_chunks,
            coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM (SELECT DISTINCT unnest(e) AS w FROM e WHERE e.doc_id = t.doc_id)), '') AS entities,
            coalesce((SELECT string_agg(link, '|' ORDER BY a, b) FROM r WHERE r.doc_id = t.doc_id), '') AS relations
          FROM t""",
        "usage_of_calls": rf"""WITH t AS (SELECT regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM documents), each AS (
            SELECT text, count(*) AS n, any_value(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS w FROM t WHERE text <> '' GROUP BY text),
          done AS (SELECT *, len(w) >= 3 AS good, len({_firsts('w')}) AS k FROM each)
          SELECT count_if(good)::BIGINT AS api_calls, 0.25::DOUBLE * count_if(good) AS estimated_cost_usd, sum(len(w)) FILTER (WHERE good)::BIGINT AS prompt_tokens, sum(2 * k) FILTER (WHERE good)::BIGINT AS completion_tokens,
            count(*) AS attempts, count_if(NOT good)::BIGINT AS failed, sum(n - 1)::BIGINT AS cache_hits, count_if(good)::BIGINT AS last_cum_calls, 0.25::DOUBLE * count_if(good) AS last_cum_cost_usd FROM done""",
        "prefix_in_file": "SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 100",
        "average_precision": rows(
            """SELECT grp, sum(p + q)::BIGINT AS n, sum(p)::BIGINT AS n_pos, CASE WHEN sum(p) > 0 THEN sum(p * (tp::DOUBLE / said)) / sum(p) END AS ap FROM (
              SELECT *, sum(p) OVER w AS tp, sum(p + q) OVER w AS said FROM steps WINDOW w AS (PARTITION BY grp ORDER BY h DESC)) GROUP BY grp""",
            steps="SELECT grp, h, count_if(y = 1) AS p, count_if(y = 0) AS q FROM " + _overall("task") + " WHERE h IS NOT NULL GROUP BY grp, h",
        ),
        "h_histogram": rows("""SELECT task, y, bin, count(*) AS n, count(*)::DOUBLE / nullif(any_value(total) * any_value(width), 0) AS density FROM (
          SELECT *, CASE WHEN width > 0 THEN least(floor((h - lo) / width), 19) ELSE 0 END::INT AS bin FROM (
            SELECT *, (max(h) OVER g - min(h) OVER g) / 20.0::DOUBLE AS width, min(h) OVER g AS lo, count(*) OVER g AS total FROM rows_ WHERE h IS NOT NULL WINDOW g AS (PARTITION BY task, y)))
          GROUP BY task, y, bin"""),
        "topk_claims": rows("""SELECT response_id, t AS H_top, CASE WHEN t IS NULL THEN 1.0::DOUBLE - eg ELSE 0.5::DOUBLE * (1.0::DOUBLE - eg) + 0.5::DOUBLE * t END AS H_critical FROM (
          SELECT s.response_id, s.eg, (SELECT avg(risk) FROM (SELECT CASE WHEN a.method IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS risk FROM edges e LEFT JOIN aligned a USING (source_id, s, r, o)
            WHERE e.response_id = s.response_id ORDER BY risk DESC LIMIT 3)) AS t FROM scored s)"""),
        "text_support": _with(("inst", "picked", "toks", "edges"), f"SELECT DISTINCT e.source_id, s, r, o FROM edges e JOIN (SELECT source_id, {_norm('context')} AS body FROM inst) b USING (source_id) WHERE {_has('body', 's')} AND {_has('body', 'o')}"),
        "single_shares": rows("SELECT response_id, h_eg, h_rp FROM rows_"),
        "skipped_responses": f"""WITH turns AS (SELECT conv_id || '-' || turn AS response_id, conv_id::VARCHAR AS source_id, conv_id, text FROM conversations), bad AS (SELECT DISTINCT source_id FROM turns ANTI JOIN labels ON doc_id = conv_id)
          SELECT 'reference' AS stage, NULL AS response_id, source_id, 'no document' AS error FROM bad
          UNION ALL SELECT 'response(skipped: ref failed)', response_id, source_id, 'reference extraction failed' FROM turns SEMI JOIN bad USING (source_id)
          UNION ALL SELECT 'response', response_id, source_id, 'few words' FROM turns ANTI JOIN bad USING (source_id) WHERE len(list_distinct({_words('text')})) < 3""",
        "corpus_instances": _CORPUS,
        "corpus_train": f"""SELECT response_id, source_id, split, CASE WHEN t2 IS NOT NULL OR (t1 IS NOT NULL AND implied = 0) THEN 1 ELSE 0 END AS y, concat_ws(',', CASE WHEN implied = 0 THEN t1 END, t2) AS types
          FROM ({_ANSWERS}) WHERE split = 'train'""",
        "corpus_scores": _with(_TO_ROWS[:-1], "SELECT response_id, source_id, Vc, Ec, Vq, Eq, Va, Ea, eg AS EG, rp AS RP, unscorable, ref_empty FROM scored", inst=_CORPUS),
        "match_by_language": _with(
            ("inst", "picked", "toks", "names"),
            """SELECT source_id, v, w AS ref, CASE kind WHEN 1 THEN 'exact' ELSE 'substring' END AS method FROM (
              SELECT *, row_number() OVER (PARTITION BY source_id, v ORDER BY kind, w) AS k FROM pairs WHERE kind < 3) WHERE k = 1""",
            wanted="SELECT DISTINCT task AS source_id, v FROM names JOIN inst USING (response_id) WHERE v <> ''",
            langrefs=f"SELECT DISTINCT task AS source_id, w FROM (SELECT task, {_norm('e')} AS w FROM (SELECT response_id, unnest(c) AS e FROM toks) JOIN inst USING (response_id)) WHERE w <> ''",
            pairs=f"SELECT source_id, v, w, CASE WHEN v = w THEN 1 WHEN {_part('v', 'w')} THEN 2 ELSE 3 END AS kind FROM wanted JOIN langrefs USING (source_id)",
        ),
        "predicate_align": _three_words(),
        "backend_graphs": rf"""SELECT doc_id, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(CASE WHEN length(text) > 6000 THEN list_append(e, 'chunk 6000') ELSE e END), '|') END AS entities,
          CASE WHEN bad THEN '' ELSE array_to_string(list_transform(list_sort(list_transform(range(1, len(e)), lambda i: {{'s': e[i], 'r': 'next', 'o': e[i + 1]}})), lambda t: t.s || '>next>' || t.o), '|') END AS relations,
          CASE WHEN bad AND regexp_matches(coalesce(text, ''), '\S') THEN 'ValueError(''too short'')' END AS error
          FROM (SELECT *, len(e) < 3 AS bad FROM (SELECT doc_id, text, {_firsts('w')} AS e FROM (SELECT doc_id, text, {_words('text')} AS w FROM documents)))""",
        "tuned_alpha_theta": _tuned(),
        "evaluation_summary": _summary(prf),
        "audit_records": _with(_TO_ROWS, f"""SELECT response_id, i.split, source_id, i.task, 0.7::DOUBLE AS alpha, round(eg, 4) AS "EG", round(rp, 4) AS "RP", Ea > 0 AS "RP_defined", coalesce(h, 0.5) >= 0.5 AS flagged, unscorable, Vc AS "Vc", Va AS "Va", Ea AS "Ea",
          ungrounded, i.y::INT AS gt_label, i.query, i.response, i.query IS NULL AS null_kept FROM rows_ r JOIN inst i USING (response_id, source_id) JOIN ({_RAW_AUDIT}) USING (response_id)"""),
    }
