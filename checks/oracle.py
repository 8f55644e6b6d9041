"""The expected result of every registered query, as DuckDB SQL over the raw tables.

Each statement is a chain of common table expressions, built from the definitions in
``checks.tables`` and nothing else.
"""

from __future__ import annotations

from .tables import DEPTH, FILTERS, K, KNEG, MODEL, POOL, SCORE_SCALE, SCORE_SHIFT

ALPHAS = [round(0.1 * i, 1) for i in range(1, 11)]

SOURCES = {
    ("passages", "docs"): "SELECT doc_id::VARCHAR AS id, text FROM documents",
    ("passages", "queries"): "SELECT item_id::VARCHAR AS id, text FROM benchmark",
    ("dialogue", "docs"): "SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant'",
    ("dialogue", "queries"): "SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user'",
}


def chain(*parts: str, final: str) -> str:
    """Common table expressions, each once, followed by the last select."""
    seen: dict[str, None] = {}
    for part in parts:
        for piece in part.split("\n;;\n"):
            seen.setdefault(piece)
    return "WITH " + ",\n".join(seen) + "\n" + final


def join_parts(*parts: str) -> str:
    return "\n;;\n".join(parts)


def encoded(name: str, source: str, salt: int = 0) -> str:
    """``name(id, vec)``: the hash model over ``source(id, text)``."""
    return join_parts(
        f"{name}_src AS ({source})",
        f"""{name}_cnt AS (
  SELECT id, ('0x' || substr(md5(t), {8 * salt + 1}, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS c
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM {name}_src) GROUP BY 1, 2)""",
        f"""{name}_val AS (
  SELECT id, dim, floor(c / sqrt(sum(c * c) OVER (PARTITION BY id)) * 1048576 + 0.5) / 1048576 AS v
  FROM {name}_cnt)""",
        f"""{name} AS (
  SELECT g.id, list(coalesce(v, 0)::DOUBLE ORDER BY d) AS vec
  FROM (SELECT id, d FROM {name}_src, range(64) r(d)) g
  LEFT JOIN {name}_val x ON x.id = g.id AND x.dim = g.d GROUP BY g.id)""",
    )


def docs(collection: str, salt: int = 0) -> str:
    return encoded(f"d{salt}", SOURCES[collection, "docs"], salt)


def queries(collection: str, salt: int = 0) -> str:
    return encoded(f"q{salt}", SOURCES[collection, "queries"], salt)


def ranking(name: str, query_table: str, doc_table: str, keys: str, k: int) -> str:
    """``name(keys, doc_id, rank, score)``: exact top k with single-precision scores."""
    return join_parts(
        f"""{name}_all AS (
  SELECT {keys}, d.id AS doc_id, list_dot_product(q.vec, d.vec)::FLOAT::DOUBLE AS score
  FROM {query_table} q, {doc_table} d)""",
        f"""{name} AS (
  SELECT * FROM (
    SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) - 1)::INT AS rank
    FROM {name}_all) WHERE rank < {k})""",
    )


def run(collection: str) -> str:
    return join_parts(
        docs(collection), queries(collection),
        "q AS (SELECT id AS query_id, vec FROM q0)",
        ranking("run", "q", "d0", "query_id", DEPTH),
    )


def qrels(collection: str) -> str:
    return join_parts(
        docs(collection, 1), queries(collection, 1),
        "qp AS (SELECT id AS query_id, vec FROM q1)",
        ranking("pool", "qp", "d1", "query_id", POOL),
        f"ce AS (SELECT query_id, doc_id, score * {SCORE_SCALE} - {SCORE_SHIFT} AS ce_score FROM pool)",
        grades("qrels", "ce"),
    )


def grades(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT query_id, doc_id, CASE WHEN ce_score <= 0 THEN 0 WHEN ce_score <= 0.25 THEN 1
    WHEN ce_score <= 0.75 THEN 2 ELSE 3 END AS relevance FROM {source})"""


DIMS = "qd AS (SELECT query_id, unnest(range(64)) AS dim, unnest(vec) AS x FROM q)"
DOC_DIMS = "dd AS (SELECT id AS doc_id, unnest(range(64)) AS dim, unnest(vec) AS y FROM d0)"


def means(name: str, members: str, keys: str = "query_id") -> str:
    return f"""{name} AS (
  SELECT {keys}, dim, avg(y) AS m FROM ({members}) f JOIN dd USING (doc_id) GROUP BY {keys}, dim)"""


def prf(name: str = "imp", k: int = K) -> str:
    return join_parts(
        DIMS, DOC_DIMS,
        means(f"{name}_pos", f"SELECT query_id, doc_id FROM run WHERE rank < {k}"),
        f"""{name} AS (SELECT qd.query_id, qd.dim, x, coalesce(x * m, 0) AS u
  FROM qd LEFT JOIN {name}_pos p ON p.query_id = qd.query_id AND p.dim = qd.dim)""",
    )


BOTTOM = "bottom AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS place FROM run)"


def eclipse(name: str = "imp", kneg: int = KNEG) -> str:
    return join_parts(
        prf("base"), BOTTOM,
        means("neg", f"SELECT query_id, doc_id FROM bottom WHERE place <= {kneg}"),
        f"""{name} AS (SELECT b.query_id, b.dim, x, 1.0::DOUBLE * u - 0.5::DOUBLE * coalesce(x * m, 0) AS u
  FROM base b LEFT JOIN neg n ON n.query_id = b.query_id AND n.dim = b.dim)""",
    )


def oracular(name: str = "imp") -> str:
    return join_parts(
        DIMS, DOC_DIMS,
        means("rel", "SELECT query_id, doc_id FROM qrels WHERE relevance >= 1"),
        f"""{name} AS (SELECT qd.query_id, qd.dim, x, coalesce(x * m, 0) AS u
  FROM qd LEFT JOIN rel p ON p.query_id = qd.query_id AND p.dim = qd.dim)""",
    )


def answer_importance() -> str:
    texts = """SELECT u.id, coalesce(a.text, u.text) AS text
  FROM (SELECT conv_id, turn, conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"""
    return join_parts(
        queries("dialogue"), "q AS (SELECT id AS query_id, vec FROM q0)", DIMS,
        encoded("ans", texts),
        "ad AS (SELECT id AS query_id, unnest(range(64)) AS dim, unnest(vec) AS y FROM ans)",
        "imp AS (SELECT query_id, dim, x, x * y AS u FROM qd JOIN ad USING (query_id, dim))",
    )


FILTER_SQL = dict(zip(FILTERS, (prf, eclipse)))

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u DESC, dim)::INT AS drank FROM imp)"""


def alpha_rows(alphas=ALPHAS) -> str:
    return "settings(alpha, a) AS (VALUES " + ", ".join(f"('{a}', {a}::DOUBLE)" for a in alphas) + ")"


def top_alpha(alphas=ALPHAS) -> str:
    return join_parts(
        RANKED, alpha_rows(alphas),
        """weights AS (
  SELECT query_id, alpha, dim, x,
         CASE WHEN drank <= greatest(1, round_even(a * 64, 0)) THEN 1.0::FLOAT ELSE 0.0::FLOAT END AS weight
  FROM ranked, settings)""",
    )


RDIME = """weights AS (
  SELECT query_id, 'rdime' AS alpha, dim, x,
         CASE WHEN u > avg(x * x - u) OVER (PARTITION BY query_id) THEN 1.0::FLOAT ELSE 0.0::FLOAT END AS weight
  FROM imp)"""

FRACTIONS = "fractions AS (SELECT query_id, alpha, avg(weight)::DOUBLE AS retained_frac FROM weights GROUP BY 1, 2)"


def masked_run(name: str = "found") -> str:
    return join_parts(
        """masked AS (
  SELECT query_id, alpha, list(x * weight::DOUBLE ORDER BY dim) AS vec FROM weights GROUP BY 1, 2)""",
        ranking(name, "masked", "d0", "query_id, alpha", DEPTH),
    )


def measured(source: str, by: str = "", settings: str = "", name: str = "per") -> str:
    """``name(by, query_id, ndcg10, ndcg100, ap, r100, rr10)`` for every judged query and setting."""
    keys = f"{by}, query_id" if by else "query_id"
    same = f"AND h.{by} = p.{by}" if by else ""
    setting = f", s.{by}" if by else ""
    cross = f", (SELECT DISTINCT {by} FROM {settings}) s" if by else ""
    group = f"p.query_id, p.n_rel, p.i10, p.i100{', p.' + by if by else ''}"
    return join_parts(
        f"""{name}_placed AS (
  SELECT {keys}, doc_id, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id DESC) AS pos
  FROM {source})""",
        f"""{name}_hits AS (
  SELECT r.*, q.relevance, row_number() OVER (PARTITION BY {', '.join('r.' + c for c in keys.split(', '))} ORDER BY pos) AS n
  FROM {name}_placed r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE q.relevance > 0)""",
        """ideal AS (
  SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS pos FROM qrels)""",
        """judged AS (
  SELECT query_id, count(*) FILTER (relevance > 0) AS n_rel,
         sum(relevance / log2(pos + 1)) FILTER (pos <= 10) AS i10,
         sum(relevance / log2(pos + 1)) FILTER (pos <= 100) AS i100 FROM ideal GROUP BY 1)""",
        f"{name}_pop AS (SELECT j.*{setting} FROM judged j{cross})",
        f"""{name} AS (
  SELECT p.query_id{', p.' + by if by else ''},
    coalesce(sum(h.relevance / log2(h.pos + 1)) FILTER (h.pos <= 10) / nullif(i10, 0), 0) AS ndcg10,
    coalesce(sum(h.relevance / log2(h.pos + 1)) FILTER (h.pos <= 100) / nullif(i100, 0), 0) AS ndcg100,
    coalesce(sum(h.n / h.pos) / nullif(n_rel, 0), 0) AS ap,
    coalesce(count(*) FILTER (h.pos <= 100) / nullif(n_rel, 0), 0) AS r100,
    coalesce(1.0 / min(h.pos) FILTER (h.pos <= 10), 0)::DOUBLE AS rr10
  FROM {name}_pop p LEFT JOIN {name}_hits h ON h.query_id = p.query_id {same} GROUP BY {group})""",
    )


MEASURE_COLUMNS = {"nDCG@10": "ndcg10", "AP": "ap", "R@100": "r100", "RR@10": "rr10", "nDCG@100": "ndcg100"}


def long_measures(name: str = "per", by: str = "", only=("nDCG@10", "AP", "R@100", "RR@10")) -> str:
    """``name_long(by, query_id, measure, value)``."""
    keys = f"{by}, query_id" if by else "query_id"
    selects = [f"SELECT {keys}, '{m}' AS measure, {MEASURE_COLUMNS[m]} AS value FROM {name}" for m in only]
    return f"{name}_long AS ({' UNION ALL '.join(selects)})"


def swept(collection: str, name: str, selector: str, alphas=ALPHAS) -> str:
    weights = {"rdime": RDIME, "soft": SOFT}.get(selector) or top_alpha(alphas)
    return join_parts(run(collection), FILTER_SQL[name](), weights, masked_run())


# importance scaled to [0, 1] per query, on a grid of sixteenths, so that sums stay exact
SOFT = """weights AS (
  SELECT query_id, 'soft' AS alpha, dim, x, floor(CASE WHEN high > low THEN (u - low) / (high - low) ELSE 1.0 END * 16) / 16 AS weight
  FROM (SELECT *, min(u) OVER (PARTITION BY query_id) AS low, max(u) OVER (PARTITION BY query_id) AS high FROM imp))"""


def swept_results(collection: str, name: str, selector: str, alphas=ALPHAS) -> str:
    return join_parts(
        swept(collection, name, selector, alphas), qrels(collection),
        measured("found", "alpha", "weights"), long_measures(by="alpha"),
    )


def results_sql() -> str:
    """``results``: everything the reports compare, from sub-selects with their own definitions."""
    columns = "collection, model, filter, selector, alpha, query_id, measure, value, retained_frac"
    parts = []
    for collection in ("passages", "dialogue"):
        base = chain(
            run(collection), qrels(collection), measured("run"), long_measures(),
            final="SELECT query_id, measure, value FROM per_long",
        )
        parts.append(
            f"SELECT '{collection}' AS collection, '{MODEL}' AS model, 'baseline' AS filter, NULL::VARCHAR AS selector, "
            f"NULL::VARCHAR AS alpha, query_id, measure, value, NULL::DOUBLE AS retained_frac FROM ({base})"
        )
        for name in FILTERS:
            for selector in ("top-alpha", "rdime"):
                extra = [FRACTIONS] if selector == "rdime" else []
                frac = "retained_frac" if extra else "NULL::DOUBLE AS retained_frac"
                source = "per_long JOIN fractions USING (query_id, alpha)" if extra else "per_long"
                found = chain(
                    swept_results(collection, name, selector), *extra,
                    final=f"SELECT query_id, alpha, measure, value, {frac} FROM {source}",
                )
                parts.append(
                    f"SELECT '{collection}' AS collection, '{MODEL}' AS model, '{name}' AS filter, "
                    f"'{selector}' AS selector, alpha, query_id, measure, value, retained_frac FROM ({found})"
                )
    union = "\nUNION ALL\n".join(f"SELECT {columns} FROM ({p})" for p in parts)
    return f"results AS MATERIALIZED ({union})"


# Code points that text normalisation unifies, and into what.
UNIFIED = {
    " ": (0x0B, 0x0C, 0x85),
    "-": (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x207B, 0x2212, 0xFF0D),
    '"': (0x201C, 0x201D, 0x201E, 0x201F),
    "'": (0x60, 0xB4, 0x55A, 0x2018, 0x2019, 0x201A, 0x201B, 0x2032, 0x2035, 0xA78B, 0xA78C, 0xFF07),
    "/": (0x2044, 0x2215),
    "''": (0x2033, 0x2036),
    "'''": (0x2034, 0x2037),
    "''''": (0x2057,),
    "...": (0x2026,),
    "": (*range(0x01, 0x09), 0x0E, 0x0F, *range(0x11, 0x1C), 0xAD),
}
# neighbours of those, which stay
KEPT = (0x09, 0x10, 0x1C, 0xAB, 0x2016, 0x2017, 0x2027, 0x2042, 0x2045, 0x223C)
INJECTED = [c for codes in UNIFIED.values() for c in codes] + list(KEPT)


def normalized(column: str) -> str:
    out = column
    for target, codes in UNIFIED.items():
        into = "concat('', " + ", ".join(f"chr({ord(c)})" for c in target) + ")" if target else "''"
        for code in codes:
            out = f"replace({out}, chr({code}), {into})"
    return f"replace({out}, ' . . . ', ' ... ')"


# every character between letters, so that none goes missing unseen
DIRTY = "text || concat(" + ", ".join(f"'a', chr({c}), 'b'" for c in INJECTED) + ") || ' . . . '"

EMB = "emb AS (SELECT vec_id::VARCHAR AS doc_id, embedding AS vec FROM embeddings)"
EMB_DIMS = "ed AS (SELECT doc_id, unnest(range(len(vec))) AS dim, unnest(vec)::DOUBLE AS value FROM emb)"
WANTED = "wanted AS (SELECT doc_id::VARCHAR AS doc_id FROM labels)"
IMP_OUT = "SELECT query_id, dim::INT AS dim, round(u, 9) + 0.0 AS importance FROM imp"
RUN_OUT = "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM run"
FOUND_OUT = "SELECT query_id, alpha, doc_id, rank, round(score, 6) AS score FROM found"
WEIGHTS_OUT = "SELECT query_id, alpha, dim::INT AS dim, weight::DOUBLE AS weight FROM weights"


def study_sql(trials: list[dict]) -> str:
    rows = ", ".join(
        f"({t['trial_id']}, {t['k']}, {t['kneg']}, {t['lambda_pos']!r}::DOUBLE, {t['lambda_neg']!r}::DOUBLE, {t['alpha']!r}::DOUBLE)"
        for t in trials
    )
    return join_parts(
        run("passages"), qrels("passages"), DIMS, DOC_DIMS, BOTTOM,
        f"trials(trial_id, k, kneg, lambda_pos, lambda_neg, alpha) AS (VALUES {rows})",
        means(
            "pos", "SELECT query_id, k, doc_id FROM run JOIN (SELECT DISTINCT k FROM trials) ON rank < k", "query_id, k"
        ),
        means(
            "neg",
            "SELECT query_id, kneg, doc_id FROM bottom JOIN (SELECT DISTINCT kneg FROM trials) ON place <= kneg",
            "query_id, kneg",
        ),
        """imp AS (
  SELECT trial_id, alpha AS a, qd.query_id, qd.dim, x,
         lambda_pos * coalesce(x * p.m, 0) - lambda_neg * coalesce(x * n.m, 0) AS u
  FROM trials t CROSS JOIN qd
  LEFT JOIN pos p ON p.query_id = qd.query_id AND p.dim = qd.dim AND p.k = t.k
  LEFT JOIN neg n ON n.query_id = qd.query_id AND n.dim = qd.dim AND n.kneg = t.kneg)""",
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY trial_id, query_id ORDER BY u DESC, dim) AS drank FROM imp)""",
        """masked AS (
  SELECT trial_id, query_id, list(CASE WHEN drank <= greatest(1, round_even(a * 64, 0)) THEN x ELSE 0 END ORDER BY dim) AS vec
  FROM ranked GROUP BY 1, 2)""",
        ranking("found", "masked", "d0", "trial_id, query_id", 100),
        measured("found", "trial_id", "trials"),
        """study AS (
  SELECT trial_id::INT AS trial_id, k::INT AS k, kneg::INT AS kneg, lambda_pos, lambda_neg, alpha, round(value, 6) AS value
  FROM trials JOIN (SELECT trial_id, avg(ndcg100) AS value FROM per GROUP BY 1) USING (trial_id))""",
    )


def _tag(label) -> str:
    return str(label).replace(".", "_")


def _best(expression: str, best: str) -> str:
    return f"coalesce(abs({expression} - ({best})) < 1e-9, false)"


def report_performance() -> str:
    measures = ("nDCG@10", "AP", "R@100", "RR@10")
    cols = []
    for c in ("passages", "dialogue"):
        for m in measures:
            where = f"collection = '{c}' AND measure = '{m}'"
            cols.append(f"round(max(mean) FILTER ({where}), 6) AS \"{c}:{m}\"")
            cols.append(f"bool_or(best) FILTER ({where}) AS \"{c}:{m}:best\"")
    return chain(
        results_sql(),
        """means AS (
  SELECT collection, model, filter, measure, avg(value) AS mean FROM results
  WHERE filter = 'baseline' OR (selector = 'top-alpha' AND alpha = '0.8') GROUP BY ALL)""",
        """flagged AS (
  SELECT *, abs(mean - max(mean) OVER (PARTITION BY collection, measure)) < 1e-9 AS best FROM means)""",
        final=f"SELECT model, filter, {', '.join(cols)} FROM flagged GROUP BY ALL",
    )


def report_comparison() -> str:
    alphas = ("0.4", "0.6", "0.8")
    picked = ", ".join(f"avg(value) FILTER (selector = 'top-alpha' AND alpha = '{a}') AS a{i}" for i, a in enumerate(alphas))
    shown = ", ".join(
        f"round(a{i}, 6) AS \"alpha_{_tag(a)}\", {_best(f'a{i}', 'greatest(a0, a1, a2)')} AS \"best_{_tag(a)}\""
        for i, a in enumerate(alphas)
    )
    return chain(
        results_sql(),
        f"""wide AS (
  SELECT collection, model, filter, {picked}, avg(value) FILTER (selector = 'rdime') AS r
  FROM results WHERE measure = 'nDCG@10' AND filter <> 'baseline' GROUP BY ALL)""",
        """kept AS (
  SELECT collection, model, filter, avg(retained_frac) AS f FROM results WHERE selector = 'rdime' GROUP BY ALL)""",
        """base AS (
  SELECT collection, model, filter, avg(value) AS r FROM results
  WHERE measure = 'nDCG@10' AND filter = 'baseline' GROUP BY ALL)""",
        final=f"""SELECT collection, model, filter, {shown}, round(r, 6) AS rdime, round(f, 6) AS retained_frac,
  round(CASE WHEN greatest(a0, a1, a2) <> 0 THEN (r - greatest(a0, a1, a2)) / greatest(a0, a1, a2) * 100 END, 6) AS delta_pct
FROM wide JOIN kept USING (collection, model, filter)
UNION ALL
SELECT collection, model, filter, {', '.join('NULL, false' for _ in alphas)}, round(r, 6), 1.0, NULL FROM base""",
    )


def report_sweep() -> str:
    picked = ", ".join(f"avg(value) FILTER (alpha = '{a}') AS a{i}" for i, a in enumerate(ALPHAS))
    best = f"greatest({', '.join(f'a{i}' for i in range(len(ALPHAS)))})"
    shown = ", ".join(
        f"round(a{i}, 6) AS \"alpha_{_tag(a)}\", {_best(f'a{i}', best)} AS \"best_{_tag(a)}\"" for i, a in enumerate(ALPHAS)
    )
    return chain(
        results_sql(),
        f"""wide AS (
  SELECT model, filter, collection, measure, {picked} FROM results
  WHERE selector = 'top-alpha' AND measure IN ('nDCG@10', 'AP') GROUP BY ALL)""",
        "base AS (SELECT collection, model, measure, avg(value) AS b FROM results WHERE filter = 'baseline' GROUP BY ALL)",
        final=f"""SELECT model, filter, collection, measure, {shown}, round(b, 6) AS baseline
FROM wide JOIN base USING (collection, model, measure)""",
    )


def oracle_sql() -> dict[str, str]:
    from .registry import RANDOM_TRIALS, TRIALS

    p, d = "passages", "dialogue"
    prf_p = join_parts(run(p), prf())
    sql = {
        "text_normalize": f"SELECT doc_id::VARCHAR AS doc_id, {normalized(f'({DIRTY})')} AS text FROM documents",
        "collection_corpus": f"SELECT doc_id::VARCHAR AS doc_id, {normalized('text')} AS text FROM documents",
        "collection_queries": "SELECT item_id::VARCHAR AS query_id, text FROM benchmark",
        "collection_qrels": """SELECT doc_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id,
  quality AS relevance FROM labels""",
        "doc_offsets": """SELECT doc_id::VARCHAR AS doc_id,
  row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS "offset" FROM documents""",
        "hash_encode": chain(docs(p), final="""SELECT id AS doc_id, unnest(range(64))::INT AS dim,
  unnest(vec) AS value FROM d0"""),
        "query_encode": chain(queries(d), final="""SELECT id AS query_id, unnest(range(64))::INT AS dim,
  unnest(vec) AS value FROM q0"""),
        "vector_lookup": chain(EMB, EMB_DIMS, WANTED, final="""SELECT doc_id, dim::INT AS dim, round(value, 6) + 0.0 AS value
  FROM ed JOIN wanted USING (doc_id)"""),
        "missing_ids": chain(EMB, WANTED, final="SELECT DISTINCT doc_id FROM wanted ANTI JOIN emb USING (doc_id)"),
        "centroid": chain(EMB, EMB_DIMS, final="SELECT dim::INT AS dim, round(avg(value), 6) + 0.0 AS value FROM ed GROUP BY 1"),
        "l2_normalize": chain(EMB, EMB_DIMS, final="""SELECT doc_id, dim::INT AS dim, round(CASE WHEN n = 0 THEN value ELSE value / n END, 6) + 0.0 AS value
  FROM ed JOIN (SELECT doc_id, sqrt(sum(value * value)) AS n FROM ed GROUP BY 1) USING (doc_id)"""),
        "l2_normalize_subset": chain(EMB, EMB_DIMS, WANTED, final="""SELECT doc_id, dim::INT AS dim, round(CASE WHEN n = 0 THEN value ELSE value / n END, 6) + 0.0 AS value
  FROM ed JOIN (SELECT doc_id, sqrt(sum(value * value)) AS n FROM ed GROUP BY 1) USING (doc_id) SEMI JOIN wanted USING (doc_id)"""),
        "vector_manifest": chain(EMB, final="""SELECT 'embeddings' AS model, count(*) AS n_items, min(len(vec))::INT AS min_dims,
  max(len(vec))::INT AS max_dims, CASE WHEN min(len(vec)) = max(len(vec)) THEN 'complete' ELSE 'incomplete' END AS status FROM emb"""),
        "baseline_topk": chain(run(p), final=RUN_OUT),
        "baseline_topk_blocks": chain(run(p), final=RUN_OUT),
        "dialogue_topk": chain(run(d), final=RUN_OUT),
        "alpha_sweep_blocks": chain(swept(p, "prf-k2", "top-alpha"), final=FOUND_OUT),
        "embeddings_topk": chain(EMB, """q AS (SELECT vec_id::VARCHAR AS query_id, list_transform(embedding, lambda v: v::DOUBLE) AS vec
  FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels))""",
            "d0 AS (SELECT doc_id AS id, list_transform(vec, lambda v: v::DOUBLE) AS vec FROM emb)",
            ranking("run", "q", "d0", "query_id", DEPTH), final="SELECT query_id, doc_id, rank, round(score, 5) + 0.0 AS score FROM run"),
        "eval_deep_run": chain(
            docs(p), queries(p), "q AS (SELECT id AS query_id, vec FROM q0)", ranking("run", "q", "d0", "query_id", 1000), qrels(p),
            """hits AS (SELECT r.query_id, count(*) AS n FROM run r JOIN qrels q
  ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE q.relevance > 0 GROUP BY 1)""",
            final="""SELECT j.query_id, 'R@1000' AS measure, round(coalesce(n / nullif(n_rel, 0), 0), 6)::DOUBLE AS value
  FROM (SELECT query_id, count(*) FILTER (relevance > 0) AS n_rel FROM qrels GROUP BY 1) j LEFT JOIN hits USING (query_id)"""),
        "query_offsets": """SELECT item_id::VARCHAR AS query_id, row_number() OVER (ORDER BY item_id) - 1 AS "offset" FROM benchmark""",
        "soft_weight_search": chain(swept(p, "prf-k2", "soft"), final=FOUND_OUT),
        "top1": chain(run(p), final="SELECT query_id, doc_id, round(score, 6) AS score FROM run WHERE rank = 0"),
        "prf_importance": chain(prf_p, final=IMP_OUT),
        "eclipse_importance": chain(run(p), eclipse(), final=IMP_OUT),
        "oracular_importance": chain(docs(p), queries(p), "q AS (SELECT id AS query_id, vec FROM q0)", qrels(p), oracular(), final=IMP_OUT),
        "answer_importance": chain(answer_importance(), final=IMP_OUT),
        "importance_ranked": chain(prf_p, RANKED, final="SELECT query_id, dim::INT AS dim, round(u, 9) + 0.0 AS importance, drank FROM ranked"),
        "importance_subset": chain(prf_p, qrels(p), final=IMP_OUT + " SEMI JOIN (SELECT query_id FROM qrels WHERE relevance = 3) USING (query_id)"),
        "top_alpha_mask": chain(prf_p, top_alpha(), final=WEIGHTS_OUT),
        "top_k_mask": chain(prf_p, RANKED, final="""SELECT query_id, dim::INT AS dim,
  CASE WHEN drank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM ranked"""),
        "rdime_mask": chain(prf_p, RDIME, final=WEIGHTS_OUT),
        "retained_frac": chain(prf_p, RDIME, FRACTIONS, final="SELECT query_id, alpha, retained_frac FROM fractions"),
        "mean_retained": chain(prf_p, RDIME, FRACTIONS, final="SELECT alpha, round(avg(retained_frac), 6) AS retained_frac FROM fractions GROUP BY 1"),
        "masked_search": chain(swept(p, "prf-k2", "top-alpha", [0.5]), final=FOUND_OUT),
        "alpha_sweep": chain(swept(p, "prf-k2", "top-alpha"), final=FOUND_OUT),
        "rdime_search": chain(swept(p, "prf-k2", "rdime"), final=FOUND_OUT),
        "eclipse_sweep": chain(swept(p, "prf-k2-eclipse", "top-alpha"), final=FOUND_OUT),
        "dialogue_answer_sweep": chain(docs(d), answer_importance(), top_alpha(), masked_run(), final=FOUND_OUT),
        "sweep_eval": chain(swept_results(p, "prf-k2", "top-alpha"), final="SELECT query_id, alpha, measure, round(value, 6) AS value FROM per_long"),
        "sweep_summary": chain(swept_results(p, "prf-k2", "top-alpha"), final="SELECT alpha, measure, round(avg(value), 6) AS mean FROM per_long GROUP BY 1, 2"),
        "sweep_summary_table": chain(swept_results(p, "prf-k2", "top-alpha"), final="""SELECT alpha, round(avg(ndcg10), 6) AS "nDCG@10", round(avg(ap), 6) AS "AP",
  round(avg(r100), 6) AS "R@100", round(avg(rr10), 6) AS "RR@10" FROM per GROUP BY 1"""),
        "results_with_retained": chain(swept_results(d, "prf-k2", "rdime"), FRACTIONS, final="""SELECT query_id, alpha, measure, round(value, 6) AS value, retained_frac
  FROM per_long LEFT JOIN fractions USING (query_id, alpha)"""),
        "eval_depth_levels": chain(run(p), qrels(p), """hits AS (
  SELECT r.query_id, relevance, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS pos FROM run) r
  JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id)""",
            "strict AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM hits WHERE relevance >= 3)",
            "rel AS (SELECT query_id, count(*) FILTER (relevance >= 3) AS n_rel FROM qrels GROUP BY 1)",
            final="""SELECT r.query_id, m.measure, round(CASE m.measure
    WHEN 'AP(rel=3)' THEN coalesce(sum(n / pos) / nullif(n_rel, 0), 0)
    WHEN 'R(rel=3)@20' THEN coalesce(count(*) FILTER (pos <= 20) / nullif(n_rel, 0), 0)
    ELSE coalesce(1.0 / min(pos), 0) END, 6) AS value
  FROM rel r CROSS JOIN (VALUES ('AP(rel=3)'), ('R(rel=3)@20'), ('RR(rel=3)')) m(measure)
  LEFT JOIN strict s ON s.query_id = r.query_id GROUP BY r.query_id, n_rel, m.measure"""),
        "run_sanity": chain(run(p), qrels(p), final=f"""SELECT 'passages' AS collection, '{MODEL}' AS model,
  count(DISTINCT query_id) AS run_queries, (SELECT count(DISTINCT query_id) FROM qrels WHERE relevance = 3) AS qrel_queries,
  count(DISTINCT query_id) FILTER (query_id NOT IN (SELECT query_id FROM qrels WHERE relevance = 3)) AS missing,
  count(*) FILTER (query_id NOT IN (SELECT query_id FROM qrels WHERE relevance = 3)) = 0 AS ok FROM run"""),
        "unjudged_queries": chain(run(p), qrels(p), final=f"""SELECT DISTINCT 'passages' AS collection, '{MODEL}' AS model, query_id FROM run
  WHERE query_id NOT IN (SELECT query_id FROM qrels WHERE relevance = 3)"""),
        "graded_qrels": chain(qrels(d), final="SELECT query_id, doc_id, relevance FROM qrels"),
        "eval_sample": chain(SAMPLE, final="SELECT query_id FROM sample"),
        "eval_run": chain(docs(d), SAMPLE, encoded("q0", SOURCES[d, "queries"] + " AND conv_id || '-' || turn IN (SELECT query_id FROM sample)"),
                          "q AS (SELECT id AS query_id, vec FROM q0)", ranking("run", "q", "d0", "query_id", DEPTH), final=RUN_OUT),
        "trial_grid": chain(study_sql(TRIALS), final="SELECT * FROM study"),
        "trial_random": chain(study_sql(RANDOM_TRIALS), final="SELECT * FROM study"),
        "best_trial": chain(study_sql(TRIALS), final="SELECT * FROM study ORDER BY value DESC, trial_id LIMIT 1"),
        "baseline_means": chain(results_sql(), final="""SELECT collection, model, measure, round(avg(value), 6) AS mean
  FROM results WHERE filter = 'baseline' GROUP BY ALL"""),
        "sweep_means": chain(results_sql(), final="""SELECT collection, model, filter, selector, measure, alpha, round(avg(value), 6) AS mean
  FROM results WHERE filter <> 'baseline' GROUP BY ALL"""),
        "retained_means": chain(results_sql(), final="""SELECT collection, model, filter, round(avg(retained_frac), 6) AS retained_frac
  FROM results WHERE selector = 'rdime' GROUP BY ALL"""),
        "report_performance": report_performance(),
        "report_comparison": report_comparison(),
        "report_sweep": report_sweep(),
        "report_retained": chain(results_sql(), final="""SELECT model, filter, round(avg(retained_frac) FILTER (collection = 'passages'), 6) AS passages,
  round(avg(retained_frac) FILTER (collection = 'dialogue'), 6) AS dialogue FROM results WHERE selector = 'rdime' GROUP BY ALL"""),
        "delta_pct": chain(results_sql(), """means AS (
  SELECT collection, model, filter, selector, alpha, measure, avg(value) AS mean FROM results WHERE filter <> 'baseline' GROUP BY ALL)""",
            "base AS (SELECT collection, model, measure, avg(value) AS ref FROM results WHERE filter = 'baseline' GROUP BY ALL)",
            final="""SELECT collection, model, filter, selector, alpha, measure,
  round(CASE WHEN ref <> 0 THEN (mean - ref) / ref * 100 END, 6) + 0.0 AS delta_pct FROM means JOIN base USING (collection, model, measure)"""),
        "conversation_answers": """SELECT conv_id::VARCHAR AS query_id, min_by(text, turn) AS text
  FROM conversations WHERE role = 'assistant' GROUP BY 1""",
    }
    for measure, column in MEASURE_COLUMNS.items():
        sql[MEASURE_QUERIES[measure]] = chain(
            run(d), qrels(d), measured("run"), final=f"SELECT query_id, '{measure}' AS measure, round({column}, 6) AS value FROM per"
        )
    every = chain(run(p), qrels(p), measured("run"), long_measures(), final="SELECT query_id, measure, round(value, 6) AS value FROM per_long")
    sql["eval_all"] = every
    sql["eval_summary"] = chain(run(p), qrels(p), measured("run"), long_measures(),
                                final="SELECT measure, round(avg(value), 6) AS mean FROM per_long GROUP BY 1")
    # documents listed or judged twice count once
    sql["eval_repeated_docs"] = every
    sql["sweep_per_query"] = chain(swept_results(p, "prf-k2", "top-alpha", [0.5]),
                                   final="SELECT query_id, measure, round(value, 6) AS value FROM per_long")
    sql["sweep_mean"] = chain(swept_results(p, "prf-k2", "top-alpha", [0.5]),
                              final="SELECT measure, round(avg(value), 6) AS mean FROM per_long GROUP BY 1")
    # what is written and read back is what was computed
    sql["build_and_search"] = sql["baseline_topk"]
    sql["run_file"] = sql["baseline_topk"]
    sql["sweep_files"] = sql["alpha_sweep"]
    sql["results_file"] = sql["results_with_retained"]
    sql["vector_files"] = sql["query_encode"]
    sql["stored_vector_lookup"] = sql["vector_lookup"]
    sql["embeddings_topk_in_blocks"] = sql["embeddings_topk"]
    sql["answers_file"] = sql["conversation_answers"]
    sql["ce_scores_file"] = chain(qrels(d), final="SELECT query_id, doc_id, round(ce_score, 6) + 0.0 AS ce_score FROM ce")
    sql["eval_set_files"] = chain(SAMPLE, qrels(d), final=f"""SELECT query_id, doc_id, relevance FROM qrels
  SEMI JOIN ({SOURCES[d, 'queries']} AND conv_id || '-' || turn IN (SELECT query_id FROM sample)) s ON s.id = qrels.query_id""")
    sql["study_files"] = sql["best_trial"]
    return sql


SAMPLE_SIZE, SAMPLE_SEED = 25, 42
SAMPLE = f"""sample AS (
  SELECT query_id FROM (SELECT conv_id || '-' || turn AS query_id FROM conversations WHERE role = 'user')
  ORDER BY md5('{SAMPLE_SEED}:' || query_id), query_id LIMIT {SAMPLE_SIZE})"""
MEASURE_QUERIES = {
    "nDCG@10": "eval_ndcg", "nDCG@100": "eval_ndcg_deep", "AP": "eval_ap", "R@100": "eval_recall", "RR@10": "eval_rr",
}
