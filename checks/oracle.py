"""DuckDB SQL with the results of ``checks.queries``, written from the definitions."""

from __future__ import annotations

import re

MEMBER = 0

CORPUS = r"""corpus AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title,
         regexp_replace(text, '[\t\n\r]+', ' ', 'g') AS lemmas, lang || ' ' || source AS tags
  FROM documents)"""

SPLIT = """split_corpus AS (
  SELECT c.doc_id, CASE WHEN l.doc_id IS NULL THEN 'test/' ELSE 'training/' END || c.id AS id,
         c.title, c.lemmas, c.tags, l.doc_id IS NOT NULL AS is_training
  FROM corpus c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = c.doc_id)"""

TOXIC = """seeds AS (
  SELECT DISTINCT CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS klass, doc_id FROM labels)"""

QUALITY = """seeds AS (
  SELECT DISTINCT CASE WHEN quality = 1 THEN 0 ELSE 1 END AS klass, doc_id FROM labels)"""


def postings(column: str = "lemmas", source: str = "corpus", name: str = "postings") -> str:
    return f"""{name} AS (
  SELECT DISTINCT unnest([x FOR x IN string_split({column}, ' ') IF x <> '']) AS term, doc_id
  FROM {source})"""


DOC_TAGS = """doc_tags AS (
  SELECT DISTINCT doc_id, unnest(string_split(tags, ' ')) AS tag FROM {source})"""


def six(x: str) -> str:
    """Six decimals, halves upwards, in arithmetic that every engine does alike."""
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def num(x: str, name: str | None = None) -> str:
    name = name or x
    return f"CASE WHEN {six(x)} = 0 THEN 0.0 ELSE {six(x)} END AS {name}"


def fin(x: str, name: str | None = None) -> str:
    name = name or x
    return (
        f"CASE WHEN NOT isfinite({x}) THEN NULL WHEN {six(x)} = 0 THEN 0.0"
        f" ELSE {six(x)} END AS {name},"
        f" CASE WHEN isnan({x}) THEN 'nan' WHEN {x} = 'inf'::DOUBLE THEN '+inf'"
        f" WHEN {x} = '-inf'::DOUBLE THEN '-inf' WHEN {x} IS NOT NULL THEN 'finite' END AS {name}_state"
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def counts(field: str = "lemmas") -> list[str]:
    return [
        f"""tokens AS (
  SELECT s.klass, unnest(string_split(c.{field}, ' ')) AS term
  FROM corpus c JOIN seeds s USING (doc_id))""",
        """pos AS (SELECT klass, term, count(*) AS p FROM tokens WHERE length(term) >= 3 GROUP BY ALL)""",
        """counted AS (
  SELECT klass, term, p, CAST(sum(p) OVER (PARTITION BY term) AS BIGINT) - p AS n0,
         (SELECT count(*) FROM seeds s WHERE s.klass = pos.klass) AS class_docs,
         (SELECT count(*) FROM seeds) AS all_docs
  FROM pos)""",
    ]


IG = {
    "ieee": "-(pc * ln(pc)) - (pnc * ln(pnc)) + pt * (pc_t * ln(pc_t) + pnc_t * ln(pnc_t))"
    " + pnt * (pc_nt * ln(pc_nt) + pnc_nt * ln(pnc_nt))",
}


def _h(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({x}) END)"


IG["limit0"] = (
    f"-{_h('pc')} - {_h('pnc')} + pt * ({_h('pc_t')} + {_h('pnc_t')})"
    f" + pnt * ({_h('pc_nt')} + {_h('pnc_nt')})"
)


def _l(n: str, size: str, pc: str, pj: str) -> str:
    return f"({n} * (ln({pc}) - ln({pj})) + ({size} - {n}) * ln(1 - {pc} / {pj}))"


def _ratio(n2: str, s2: str) -> str:
    n1, s1, both_n, both_s = "p", "cd", f"(p + {n2})", f"(cd + {s2})"
    return (
        f"{_l(n2, s2, both_n, both_s)} + {_l(n1, s1, both_n, both_s)}"
        f" - {_l(n1, s1, n1, s1)} - {_l(n2, s2, n2, s2)}"
    )


def _f(*xs: str) -> str:
    return "(" + " + ".join(f"({x}) * ln({x}) / t" for x in xs) + ")"


SCORES = {
    "odds": "ln(p) - ln(n)",
    "mi_ratio": "p * t / ((p + (cd - p)) * (p + n))",
    "freq": "p + n",
    "mi": "ptc * ln(ptc / (pc * ptu)) + ptnc * ln(ptnc / (pnc * ptu))"
    " + pntc * ln(pntc / (pc * pnt)) + pntnc * ln(pntnc / (pnc * pnt))",
    "mi_term": "ptc * ln(ptc / (pc * ptu)) + ptnc * ln(ptnc / (pnc * ptu))",
    "mi_classweighted": "pc * ln(ptc / (pc * ptu)) + pnc * ln(ptnc / (pnc * ptu))",
    "mi_max": "greatest(pc * ln(ptc / (pc * ptu)), pnc * ln(ptnc / (pnc * ptu)))",
    "mi1": "ln(ptc) - (ln(pc) + ln(ptu))",
    "mi2": "ptc * (ln(ptc) - (ln(pc) + ln(ptu))) + ptnc * (ln(ptnc) - (ln(pnc) + ln(ptu)))",
    "mi3": f"(ln(t) - {_f('cd', 't - cd')}) + (ln(t) - {_f('p + n', 't - (p + n)')})"
    f" - (ln(t) - {_f('p', 'n', 'cd - p', '(t - cd) - n')})",
    "df": "ln(df) - n_docs",
    "ll": "log_likelihood",
    "lr1": _ratio("n", "(t - cd)"),
    "lr2": _ratio("df", "n_docs"),
    "lr3": _ratio("(p + n)", "t"),
}


def model(
    score: str = IG["ieee"],
    total: str = "all_docs + u",
    field: str = "lemmas",
    collection: bool = False,
    collection_pt: bool = False,
    likelihood: str = "ln(p) - ln(nc) - ln(n) + ln(t - nc)",
    where: str = "true",
) -> list[str]:
    """CTEs up to ``model`` (klass, term, p, n, nc, t, log_likelihood, score)."""
    extra = []
    df = "0 AS df, 0 AS n_docs"
    if collection:
        extra = [
            postings(name="all_postings"),
            "freqs AS (SELECT term AS ft, count(*) AS df FROM all_postings GROUP BY term)",
        ]
        df = (
            "coalesce((SELECT f.df FROM freqs f WHERE f.ft = u.term), 0)::DOUBLE AS df,"
            " (SELECT count(*) FROM corpus)::DOUBLE AS n_docs"
        )
    return [
        *counts(field),
        *extra,
        "unseen AS (SELECT *, CASE WHEN n0 = 0 THEN 1 ELSE 0 END AS u FROM counted)",
        f"totals AS (SELECT *, {total} AS total FROM unseen)",
        f"""smoothed AS (
  SELECT klass, term, p::DOUBLE AS p, (n0 + u)::DOUBLE AS n, (class_docs + u)::DOUBLE AS nc,
         class_docs::DOUBLE AS cd, total::DOUBLE AS t, {df}
  FROM totals u)""",
        f"""probs AS (
  SELECT *, {likelihood} AS log_likelihood,
         nc / t AS pc, 1 - nc / t AS pnc, (p + n) / t AS pt, 1 - (p + n) / t AS pnt,
         {"df / n_docs" if collection_pt else "(p + n) / t"} AS ptu,
         p / (p + n) AS pc_t, n / (p + n) AS pnc_t,
         (nc - p) / (t - (p + n)) AS pc_nt, (t - (nc + n)) / (t - (p + n)) AS pnc_nt,
         p / t AS ptc, n / t AS ptnc, (nc - p) / t AS pntc, (t - (nc + n)) / t AS pntnc
  FROM smoothed)""",
        f"""model AS (SELECT klass, term, p, n, nc, t, log_likelihood, {score} AS score
  FROM probs WHERE {where})""",
    ]


DRIFT = (
    "all_docs + sum(u) OVER (ORDER BY klass, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY klass ORDER BY {key} DESC{nulls}, term) AS rank FROM model)"""
BY_SCORE = RANKED.format(key="score", nulls="")
BY_SCORE_NAN_LAST = RANKED.format(
    key="CASE WHEN isnan(score) THEN NULL ELSE score END", nulls=" NULLS LAST"
)


def features(n: int) -> str:
    return f"features AS (SELECT * FROM ranked WHERE klass = {MEMBER} AND rank <= {n})"


SCORED = """scores AS (
  SELECT f.klass, s.doc_id, sum(f.log_likelihood ORDER BY f.rank) AS score
  FROM postings s JOIN features f USING (term) GROUP BY ALL)"""


def scored(n: int = 50, total: str = "all_docs + u", labels: str = TOXIC, field: str = "lemmas") -> str:
    return with_(
        CORPUS,
        labels,
        *model(total=total, field=field),
        BY_SCORE,
        features(n),
        postings(field),
        SCORED,
    )


def doc_scores(weights: str, docs: str = "corpus", id_col: str = "doc_id") -> str:
    return f"""SELECT d.doc_id, {num("coalesce(sum(w.log_likelihood), 0.0)", "score")}
FROM (SELECT {id_col} AS doc_id, unnest(string_split(lemmas, ' ')) AS term FROM {docs}) d
LEFT JOIN ({weights}) w USING (term) GROUP BY d.doc_id"""


ALL_WEIGHTS = f"SELECT term, log_likelihood FROM model WHERE klass = {MEMBER}"

SNIPPET = (
    "CASE WHEN length({0}) > 76 THEN substring({0}, 1, 75) || '...' ELSE {0} END AS snippet"
)


def search(
    labels: str = TOXIC, field: str = "lemmas", place: str = "", order: str = "score DESC, doc_id"
) -> str:
    position = f", row_number() OVER (ORDER BY best.{order.replace(', ', ', best.')}) AS position"
    return (
        scored(51, labels=labels, field=field)
        + f""", best AS (
  SELECT doc_id, score FROM scores WHERE doc_id NOT IN (SELECT doc_id FROM seeds)
  ORDER BY score DESC, doc_id LIMIT 20)
SELECT doc_id, {num("score")}, id, coalesce(title, '') AS title, {SNIPPET.format(field)}{position if place else ""}
FROM best JOIN corpus USING (doc_id)"""
    )


FREE = """, free AS (
  SELECT c.id, s.score FROM scores s JOIN corpus c USING (doc_id)
  WHERE s.doc_id NOT IN (SELECT doc_id FROM seeds))
"""


KNOWN = """seeds AS (
  SELECT DISTINCT CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS klass, doc_id FROM labels WHERE quality = 1)"""
CANDIDATES = with_(
    CORPUS, SPLIT, KNOWN, *model(), BY_SCORE, features(50), postings(), SCORED
) + """, free AS (
  SELECT c.id, s.score FROM scores s JOIN split_corpus c USING (doc_id)
  WHERE c.is_training AND s.doc_id NOT IN (SELECT doc_id FROM seeds))
"""


RANKING = """ranking AS (
  SELECT klass, id, gold, row_number() OVER w AS position,
         CAST(sum(CASE WHEN gold THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp
  FROM facts WHERE NOT is_training WINDOW w AS (PARTITION BY klass ORDER BY score DESC, id))"""
CURVE = """curve AS (
  SELECT *, CASE WHEN tp = 0 THEN 'nan'::DOUBLE ELSE (2 * tp)::DOUBLE / (position + n_gold) END AS f1 FROM (
    SELECT klass, n_gold, position, id, tp, tp::DOUBLE / position AS p, tp::DOUBLE / n_gold AS r
    FROM ranking JOIN overview USING (klass)))"""
POINTS = """points AS (
  SELECT m.*, coalesce(k.tp, 0) AS tp, coalesce(k.p, 'nan'::DOUBLE) AS p,
         coalesce(k.r, 0::DOUBLE / m.n_gold) AS r, coalesce(k.f1, 'nan'::DOUBLE) AS f1
  FROM meeting m LEFT JOIN curve k ON k.klass = m.klass AND k.position = m.position)"""


def tags_model(drift: bool = False) -> str:
    """CTEs of the one-against-the-rest experiment up to ``ranking`` over the test documents."""
    total = (
        "all_docs + sum(u) OVER (PARTITION BY klass ORDER BY term"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        if drift
        else "all_docs + u"
    )
    tail = model(total=total)[3:]
    return with_(
        CORPUS,
        SPLIT,
        DOC_TAGS.format(source="corpus"),
        """overview AS (
  SELECT g.tag AS klass, (SELECT count(*) FROM split_corpus WHERE is_training) AS n_train,
         count(*) FILTER (WHERE c.is_training) AS n_pos,
         count(*) FILTER (WHERE NOT c.is_training) AS n_gold
  FROM doc_tags g JOIN split_corpus c USING (doc_id) GROUP BY g.tag)""",
        """tokens AS (
  SELECT doc_id, unnest(string_split(lemmas, ' ')) AS term FROM split_corpus WHERE is_training)""",
        "terms AS (SELECT doc_id, term, count(*) AS c FROM tokens WHERE length(term) >= 3 GROUP BY ALL)",
        "everything AS (SELECT term, CAST(sum(c) AS BIGINT) AS every FROM terms GROUP BY term)",
        """pos AS (SELECT g.tag AS klass, term, CAST(sum(c) AS BIGINT) AS p
  FROM terms JOIN doc_tags g USING (doc_id) GROUP BY ALL)""",
        """counted AS (
  SELECT pos.klass, pos.term, p, every - p AS n0, o.n_pos AS class_docs, o.n_train AS all_docs
  FROM pos JOIN everything USING (term) JOIN overview o ON o.klass = pos.klass)""",
        *tail,
        BY_SCORE,
        "features AS (SELECT * FROM ranked WHERE rank <= 50)",
        postings(),
        SCORED,
        """facts AS (
  SELECT s.klass, c.id, s.score, c.is_training,
         EXISTS (SELECT 1 FROM doc_tags g WHERE g.doc_id = s.doc_id AND g.tag = s.klass) AS gold
  FROM scores s JOIN split_corpus c USING (doc_id))""",
        RANKING,
        CURVE,
        # The definition itself: the first rank with r <> 0 and r >= p, else the last rank.
        """meeting AS (
  SELECT o.klass, o.n_train, o.n_pos, o.n_train - o.n_pos AS n_neg, o.n_gold,
         coalesce((SELECT min(position) FROM curve k WHERE k.klass = o.klass AND r <> 0 AND r >= p),
                  (SELECT max(position) FROM curve k WHERE k.klass = o.klass)) AS position
  FROM overview o)""",
        POINTS,
    )


MEETING = """meeting AS (
  SELECT o.*, coalesce((SELECT min(position) FROM curve k WHERE k.klass = o.klass AND r <> 0 AND r >= p),
                       (SELECT max(position) FROM curve k WHERE k.klass = o.klass)) AS position
  FROM sizes o)"""


def learning_rounds(n: int) -> str:
    """``n`` rounds of active learning, one after another: every round has its own tables."""
    own = "sizes counted unseen totals smoothed probs model ranked features scores facts ranking curve meeting points chosen"
    ctes = [
        CORPUS,
        SPLIT,
        DOC_TAGS.format(source="corpus"),
        """gold AS (SELECT g.tag AS klass, count(*) FILTER (WHERE NOT c.is_training) AS n_gold
  FROM doc_tags g JOIN split_corpus c USING (doc_id) GROUP BY g.tag)""",
        """terms AS (
  SELECT doc_id, term, count(*) AS c FROM (
    SELECT doc_id, unnest(string_split(lemmas, ' ')) AS term FROM split_corpus WHERE is_training)
  WHERE length(term) >= 3 GROUP BY ALL)""",
        """pool AS (
  SELECT DISTINCT doc_id FROM (
    SELECT g.doc_id, row_number() OVER (PARTITION BY g.tag ORDER BY md5('7:' || c.id), c.id) AS place
    FROM doc_tags g JOIN split_corpus c USING (doc_id) WHERE c.is_training)
  WHERE place <= 8)""",
        """labelled_0 AS (
  SELECT k.klass, p.doc_id, (p.doc_id, k.klass) IN (SELECT (doc_id, tag) FROM doc_tags) AS gold
  FROM pool p, (SELECT DISTINCT tag AS klass FROM doc_tags WHERE doc_id IN (SELECT doc_id FROM pool)) k)""",
        postings(),
    ]
    for i in range(n):
        step = [
            f"""sizes AS (
  SELECT klass, count(*) AS n_train, count(*) FILTER (WHERE gold) AS n_pos,
         count(*) FILTER (WHERE NOT gold) AS n_neg, any_value(n_gold) AS n_gold
  FROM labelled_{i} JOIN gold USING (klass) GROUP BY klass)""",
            f"""counted AS (
  SELECT klass, term, CAST(sum(c) FILTER (WHERE l.gold) AS BIGINT) AS p,
         CAST(coalesce(sum(c) FILTER (WHERE NOT l.gold), 0) AS BIGINT) AS n0,
         any_value(n_pos) AS class_docs, any_value(n_train) AS all_docs
  FROM labelled_{i} l JOIN terms USING (doc_id) JOIN sizes USING (klass)
  GROUP BY klass, term HAVING p > 0)""",
            *model()[3:],
            BY_SCORE,
            "features AS (SELECT * FROM ranked WHERE rank <= 50)",
            SCORED,
            f"""facts AS (
  SELECT s.klass, s.doc_id, c.id, s.score, c.is_training,
         (s.doc_id, s.klass) IN (SELECT (doc_id, tag) FROM doc_tags) AS gold
  FROM scores s JOIN split_corpus c USING (doc_id)
  WHERE (s.klass, s.doc_id) NOT IN (SELECT (klass, doc_id) FROM labelled_{i}))""",
            RANKING,
            CURVE.replace("overview", "sizes"),
            MEETING,
            POINTS,
            """chosen AS (
  SELECT klass, doc_id, gold FROM (
    SELECT *, row_number() OVER (PARTITION BY klass ORDER BY score DESC, id) AS place
    FROM facts JOIN (SELECT klass, n_train FROM sizes) USING (klass) WHERE is_training)
  WHERE place <= n_train)""",
            f"""labelled_{i + 1} AS (
  SELECT * FROM labelled_{i} WHERE klass IN (SELECT klass FROM chosen)
  UNION ALL SELECT klass, doc_id, gold FROM chosen)""",
        ]
        named = re.compile(rf"\b({'|'.join(own.split())})\b(?! BY)")
        ctes += [named.sub(rf"\1_{i}", cte) for cte in step]
    ctes = [re.sub(r"^(\w+) AS \(", r"\1 AS MATERIALIZED (", cte) for cte in ctes]
    return with_(*ctes) + " UNION ALL ".join(
        f"SELECT klass, {i} AS round, n_train, n_pos, n_neg, {RATES} FROM points_{i}" for i in range(n)
    )


RATES = ", ".join(fin(x) for x in ("p", "r", "f1"))

TSV = f"""{CORPUS},
lines AS (
  SELECT doc_id, 1 AS pos, concat_ws(chr(9), id, title, lemmas, tags) AS value FROM corpus
  UNION ALL SELECT doc_id, 2, concat_ws(chr(9), id, tags) FROM corpus),
numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) AS line_no, value, string_split(value, chr(9)) AS cols
  FROM lines)"""

T_MODEL = with_(CORPUS, TOXIC, *model())
T_RANKED = with_(CORPUS, TOXIC, *model(), BY_SCORE)
MODEL_ROW = f"klass, term, p, n, nc, t AS total, {fin('log_likelihood')}"

ORACLE: dict[str, str] = {
    "stored_documents": with_(CORPUS)
    + "SELECT doc_id, id, title, length(lemmas) AS n_chars, tags FROM corpus",
    "documents_without_text": with_(CORPUS)
    + "SELECT count(*) FILTER (WHERE lemmas IS NULL) AS n_without_text FROM corpus",
    "postings_build": with_(CORPUS, postings()) + "SELECT term, doc_id FROM postings",
    "title_postings": with_(CORPUS, postings("title")) + "SELECT term, doc_id FROM postings",
    "text_df": with_(CORPUS, postings())
    + "SELECT term, count(*) AS df, (SELECT count(*) FROM corpus) AS n_docs FROM postings GROUP BY term",
    "title_df": with_(CORPUS, postings("title"))
    + "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "tag_table": with_(CORPUS, DOC_TAGS.format(source="corpus")) + "SELECT doc_id, tag FROM doc_tags",
    "documents_with_tag": "SELECT doc_id FROM documents WHERE lang = 'de'",
    "tsv_valid": f"""WITH {TSV}
SELECT line_no, cols[1] AS id, cols[2] AS title, cols[3] AS lemmas,
       CASE WHEN len(cols) > 3 THEN array_to_string(cols[4:], chr(9)) END AS tags
FROM numbered WHERE len(cols) >= 3""",
    "tsv_rejects": f"WITH {TSV} SELECT line_no, value AS raw_line FROM numbered WHERE len(cols) < 3",
    "index_from_file_df": f"""WITH {TSV},
valid AS (
  SELECT line_no AS doc_id, cols[2] AS title, cols[3] AS lemmas, cols[4] AS tags
  FROM numbered WHERE len(cols) >= 3),
{postings(source="valid")},
{postings("title", "valid", "title_terms")},
{DOC_TAGS.format(source="valid")}
SELECT 'text' AS kind, term, count(*) AS df FROM postings GROUP BY term
UNION ALL SELECT 'title', term, count(*) FROM title_terms GROUP BY term
UNION ALL SELECT 'tag', tag, count(*) FROM doc_tags GROUP BY tag
UNION ALL SELECT 'rejects', '', count(*) FROM numbered WHERE len(cols) < 3""",
    "first_document_of_several_files": """WITH placed AS (
  SELECT source AS id, doc_id AS first_doc, row_number() OVER (ORDER BY lang, doc_id) - 1 AS doc_id
  FROM documents)
SELECT id, min(doc_id) AS doc_id, arg_min(first_doc, doc_id) AS first_doc FROM placed GROUP BY id""",
    "seed_labels": """SELECT DISTINCT CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS klass, doc_id
FROM labels JOIN documents USING (doc_id) WHERE quality <> 0""",
    "unknown_seeds": """SELECT DISTINCT 0 AS klass, 'item' || CAST(item_id AS VARCHAR) AS id FROM benchmark
UNION SELECT CASE WHEN toxic = 1 THEN 0 ELSE 1 END, CAST(doc_id AS VARCHAR) FROM labels
WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "first_document_of_repeated_id": "SELECT source AS id, min(doc_id) AS doc_id FROM documents GROUP BY source",
    "training_test_split": """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS is_training,
 doc_id NOT IN (SELECT doc_id FROM labels) AS is_test FROM documents""",
    "complement_negatives": "SELECT doc_id FROM labels WHERE toxic <> 1",
    "labels_union": """SELECT CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS klass, doc_id FROM labels
UNION SELECT quality, doc_id FROM labels""",
    "label_sizes": with_(TOXIC) + "SELECT klass, count(*) AS class_docs FROM seeds GROUP BY klass",
    "class_priors": with_(TOXIC)
    + f"""SELECT klass, class_docs, {fin("log_prior")} FROM (
  SELECT klass, class_docs, ln(class_docs::DOUBLE) - ln((all_docs - class_docs)::DOUBLE) AS log_prior FROM (
    SELECT klass, count(*) AS class_docs, (SELECT count(*) FROM seeds) AS all_docs
    FROM seeds GROUP BY klass))""",
    "class_priors_sequential": with_(CORPUS, TOXIC, *counts())
    + f"""SELECT klass, class_docs, {fin("log_prior")} FROM (
  SELECT klass, class_docs, ln(class_docs::DOUBLE) - ln((all_docs
      + coalesce(sum(u) OVER (ORDER BY klass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      - class_docs)::DOUBLE) AS log_prior
  FROM (SELECT klass, class_docs, all_docs, count(*) FILTER (WHERE n0 = 0) AS u
        FROM counted GROUP BY ALL))""",
    "term_counts": with_(CORPUS, TOXIC, *counts())
    + "SELECT klass, term, p, n0 AS n, class_docs, all_docs FROM counted",
    "model_local": T_MODEL + f"SELECT {MODEL_ROW} FROM model",
    "model_sequential": with_(CORPUS, TOXIC, *model(total=DRIFT)) + f"SELECT {MODEL_ROW} FROM model",
    "model_given_order": with_(CORPUS, TOXIC, *model(total=DRIFT.replace("klass, term", "klass, length(term), term")))
    + f"SELECT {MODEL_ROW} FROM model",
    "feature_ig_rank": T_RANKED + f"SELECT klass, rank, term, {fin('score')} FROM ranked",
    "feature_ig_rank_limit0": with_(CORPUS, TOXIC, *model(IG["limit0"]), BY_SCORE_NAN_LAST)
    + f"SELECT klass, rank, term, {fin('score')} FROM ranked",
    "feature_best_50": T_RANKED + f"SELECT klass, rank, term, {fin('score')} FROM ranked WHERE rank <= 50",
    **{
        f"feature_score_{name}": with_(CORPUS, TOXIC, *model(expression, collection=name in ("df", "lr2")))
        + f"SELECT klass, term, {fin('score')} FROM model"
        for name, expression in SCORES.items()
    },
    "feature_score_collection_pt": with_(
        CORPUS, TOXIC, *model(SCORES["mi_term"], collection=True, collection_pt=True)
    )
    + f"SELECT klass, term, {fin('score')} FROM model",
    "feature_score_positive_only": with_(CORPUS, TOXIC, *model(where="log_likelihood > 0"))
    + f"SELECT klass, term, {fin('score')} FROM model",
    "likelihood_odds": with_(CORPUS, TOXIC, *model(likelihood="ln(p) - ln(n)"))
    + f"SELECT klass, term, {fin('log_likelihood')} FROM model",
    "likelihood_odds_share": with_(CORPUS, TOXIC, *model(likelihood="ln(p) - ln(n) - ln(p + n)"))
    + f"SELECT klass, term, {fin('log_likelihood')} FROM model",
    "model_saved_and_loaded": T_RANKED
    + f"""SELECT klass, rank, term, class_docs, {fin("log_likelihood")}, {fin("log_prior")}
FROM ranked JOIN (
  SELECT klass, class_docs, ln(class_docs::DOUBLE) - ln((all_docs - class_docs)::DOUBLE) AS log_prior
  FROM (SELECT DISTINCT klass, class_docs, all_docs FROM counted)) USING (klass)""",
    "model_listing_lines": T_RANKED
    + """SELECT 0 AS part, klass, rank, term AS line FROM ranked
UNION ALL SELECT 1, klass, rank, term || '/' || CAST(CAST(log_likelihood AS DECIMAL(18,6)) AS VARCHAR) FROM ranked""",
    "feature_trace_51": T_RANKED
    + f"""SELECT rank - 1 AS iteration, term AS feature, {num("log_likelihood")} FROM ranked
WHERE klass = {MEMBER} AND rank <= 51""",
    "score_postings_50": scored(50) + f"SELECT klass, doc_id, {num('score')} FROM scores",
    "score_postings_51": scored(51) + f"SELECT klass, doc_id, {num('score')} FROM scores",
    "score_postings_sequential": scored(50, DRIFT) + f"SELECT klass, doc_id, {num('score')} FROM scores",
    "score_docs_all": T_MODEL + doc_scores(ALL_WEIGHTS),
    "score_docs_best_50": T_RANKED
    + doc_scores(f"SELECT term, log_likelihood FROM ranked WHERE klass = {MEMBER} AND rank <= 50"),
    "score_docs_no_feature": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents",
    "score_stored_documents": T_MODEL
    + doc_scores(ALL_WEIGHTS, "(SELECT * FROM corpus WHERE doc_id IN (SELECT doc_id FROM labels))"),
    "score_conversations": T_MODEL
    + doc_scores(
        ALL_WEIGHTS,
        r"(SELECT conv_id || '/' || turn AS key, regexp_replace(text, '[\t\n\r]+', ' ', 'g') AS lemmas"
        " FROM conversations)",
        "key",
    ),
    "step_scores": scored(50)
    + f"""SELECT klass, doc_id, rank - 1 AS iteration, {num("log_score")} FROM (
  SELECT f.klass, s.doc_id, f.rank, sum(f.log_likelihood) OVER (
    PARTITION BY s.doc_id ORDER BY f.rank ROWS UNBOUNDED PRECEDING) AS log_score
  FROM postings s JOIN features f USING (term))""",
    "resumed_scores": scored(50) + f"SELECT klass, doc_id, {num('score')} FROM scores",
    "member_flags": scored(50)
    + "SELECT doc_id, score > 0 AS is_member, printf('%.6e', exp(score)) AS odds FROM scores",
    "search_top20": search(place="position"),
    "search_stored_index_top20": search(),
    "search_result_lines": "SELECT concat_ws(chr(9), CAST(score AS VARCHAR), id, title, snippet) AS line"
    f" FROM ({search()})",
    "search_quality_worst_first": search(QUALITY, place="position", order="score, doc_id DESC"),
    "search_titles_top20": search(field="title"),
    "unlabelled_ranking": scored(50)
    + FREE
    + f"SELECT id, {num('score')}, row_number() OVER (ORDER BY free.score DESC, id) AS position FROM free",
    "next_example_top": CANDIDATES
    + f"SELECT id, {num('score')} FROM free ORDER BY free.score DESC, id LIMIT 1",
    "next_example_uncertain": CANDIDATES
    + f"SELECT id, {num('score')} FROM free ORDER BY abs(free.score), id LIMIT 1",
    "next_example_random": CANDIDATES
    + f"SELECT id, {num('score')} FROM free ORDER BY md5('7:' || id), id LIMIT 1",
    "train_from_id_sets": T_MODEL + f"SELECT klass, term, {fin('log_likelihood')} FROM model",
    "train_from_stored_index": T_MODEL + f"SELECT klass, term, {fin('log_likelihood')} FROM model",
    "forward_index": with_(CORPUS)
    + """SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(string_split(lemmas, ' ')) AS term FROM corpus)
WHERE length(term) >= 3 GROUP BY doc_id, term""",
    "lexicon_df": with_(CORPUS, postings(), postings("title", name="title_terms"))
    + """SELECT 'text' AS field, term, count(*) AS df FROM postings GROUP BY term
UNION ALL SELECT 'title', term, count(*) FROM title_terms GROUP BY term""",
    "score_collection": scored(50)
    + f"SELECT doc_id, id, {num('score')} FROM scores JOIN corpus USING (doc_id)",
    "gold_flags": tags_model() + "SELECT klass, id, gold FROM facts",
    "confusion_counts": tags_model()
    + """SELECT klass, count(*) FILTER (WHERE gold) AS tp, count(*) FILTER (WHERE NOT gold) AS fp,
 count(*) AS retrieved FROM facts WHERE NOT is_training GROUP BY klass""",
    "pr_curve": tags_model() + f"SELECT klass, position, id, tp, {RATES} FROM curve",
    "break_even_points": tags_model()
    + f"SELECT klass, n_gold, coalesce(position, 0) AS position, {RATES} FROM points",
    "class_overview": tags_model() + "SELECT klass, n_train, n_pos, n_train - n_pos AS n_neg, n_gold FROM overview",
    "active_learning_rounds": learning_rounds(3),
    "evaluation_report": tags_model()
    + f"""SELECT concat_ws(' ', klass, n_train, n_pos, n_neg, {", ".join(
        f"CASE WHEN isnan({x}) THEN 'NaN' ELSE CAST(CAST({six(x)} AS DECIMAL(9,6)) AS VARCHAR) END"
        for x in ("p", "r", "f1"))}) AS line FROM points""",
    "one_vs_rest_tags": tags_model() + f"SELECT klass, n_train, n_pos, n_neg, {RATES} FROM points",
    "one_vs_rest_sequential": tags_model(drift=True)
    + f"SELECT klass, n_train, n_pos, n_neg, {RATES} FROM points",
}
