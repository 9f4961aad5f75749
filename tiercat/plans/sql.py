"""Oracle SQL building blocks (DuckDB dialect), written from the operator definitions in

Each function returns one or more common table expressions; :func:`with_ctes` assembles a
statement. The oracle runs at sf0.01, so the rare threshold there is 10.
"""

from __future__ import annotations

ORACLE_MIN_COUNT = 10


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


TXN = """txn AS (
  SELECT d.doc_id,
         d.text AS clean_description,
         CASE WHEN l.quality = 1 THEN ' Credit' WHEN l.quality = 0 THEN 'DEBIT' END AS type,
         d.lang AS category,
         d.lang || '/' || d.source AS sub_category
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

TXN_NULLS = TXN + """,
txn_nulls AS (
  SELECT doc_id,
         CASE WHEN doc_id % 11 = 0 THEN NULL
              WHEN doc_id % 13 = 0 THEN '  '
              WHEN doc_id % 7 = 0 THEN chr(9) || clean_description || chr(10) || ' '
              ELSE clean_description END AS clean_description,
         type,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE category END AS category,
         CASE WHEN doc_id % 19 = 0 THEN NULL ELSE sub_category END AS sub_category
  FROM txn)"""

TXN_M2M = """txn_m2m AS (
  SELECT event_id AS doc_id, props AS clean_description, CAST(NULL AS VARCHAR) AS type,
         event_type AS category,
         'u' || CAST(length(event_type) % 3 + user_id % 4 AS VARCHAR) AS sub_category
  FROM events)"""

# Python's str.strip on the fixture's padding (tab, newline, space) = RE2 \s at both ends.
STRIP = "regexp_replace(clean_description, '^\\s+|\\s+$', '', 'g')"


def cleaned(src: str, name: str = "cleaned") -> str:
    return f"""{name} AS (
  SELECT * REPLACE ({STRIP} AS clean_description)
  FROM {src}
  WHERE clean_description IS NOT NULL AND category IS NOT NULL AND sub_category IS NOT NULL
    AND {STRIP} <> '')"""


def prepared(src: str = "txn", min_count: int = ORACLE_MIN_COUNT, seed: int = 42) -> str:
    """cleaned -> kept (rare filter) -> enc (ids) -> prepared (with split)."""
    return cleaned(src) + f""",
freq AS (SELECT sub_category FROM cleaned GROUP BY sub_category HAVING count(*) >= {min_count}),
kept AS (SELECT * FROM cleaned WHERE sub_category IN (SELECT sub_category FROM freq)),
cat_dict AS (SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS category_id
             FROM (SELECT DISTINCT category FROM kept)),
sub_dict AS (SELECT sub_category, CAST(dense_rank() OVER (ORDER BY sub_category) - 1 AS INTEGER) AS subcategory_id
             FROM (SELECT DISTINCT sub_category FROM kept)),
enc AS (SELECT k.*, c.category_id, s.subcategory_id
        FROM kept k JOIN cat_dict c USING (category) JOIN sub_dict s USING (sub_category)),
cls AS (SELECT subcategory_id, sub_category, count(*) AS n FROM enc GROUP BY 1, 2),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS big_n,
               CAST(sum(n) AS BIGINT) - CAST(ceil(CAST(sum(n) AS DOUBLE) * 0.2) AS BIGINT) AS t
        FROM cls),
quota0 AS (SELECT cls.*, (n * t) // big_n AS base, (n * t) % big_n AS rem, t FROM cls, tot),
quota AS (SELECT subcategory_id,
                 base + CASE WHEN row_number() OVER (ORDER BY rem DESC, sub_category)
                                  <= t - sum(base) OVER () THEN 1 ELSE 0 END AS n_train
          FROM quota0),
ranked AS (SELECT e.*, row_number() OVER (
                 PARTITION BY subcategory_id
                 ORDER BY md5(CAST(doc_id AS VARCHAR) || '|{seed}'), doc_id) AS rn
           FROM enc e),
prepared AS (SELECT r.* EXCLUDE (rn),
                    CASE WHEN r.rn <= q.n_train THEN 'train' ELSE 'val' END AS split
             FROM ranked r JOIN quota q USING (subcategory_id))"""


def prepared_txn() -> str:
    return TXN + ",\n" + prepared("txn")


def class_counts_k() -> str:
    """Number of classes per level of the prepared table (k_cat, k_sub)."""
    return """k AS (SELECT (SELECT count(*) FROM cat_dict) AS k_cat,
                  (SELECT count(*) FROM sub_dict) AS k_sub)"""


def preds() -> str:
    """Deterministic predictions on the validation split."""
    return class_counts_k() + """,
preds AS (
  SELECT p.doc_id, p.category_id, p.subcategory_id,
         CAST(CASE WHEN p.doc_id % 5 = 0 THEN (p.category_id + 1) % k.k_cat ELSE p.category_id END AS INTEGER) AS pred_category_id,
         CAST(CASE WHEN p.doc_id % 5 = 0 THEN (p.subcategory_id + 1) % k.k_sub ELSE p.subcategory_id END AS INTEGER) AS pred_subcategory_id
  FROM prepared p, k WHERE p.split = 'val')"""


def fine(key: str, k: str) -> str:
    return (f"list_transform(range({k}), lambda j: "
            f"CAST(({key} * 7919 + j * 104729) % 1009 AS DOUBLE) / 1009.0)")


def coarse(key: str, k: str) -> str:
    return (f"list_transform(range({k}), lambda j: "
            f"CAST(({key} * 31 + j * j * 17) % 5 AS DOUBLE) / 5.0)")


def scores(coarse_cat: bool = False) -> str:
    """Deterministic probabilities on the validation split, plus the category map."""
    cat = coarse("p.doc_id", "k.k_cat") if coarse_cat else fine("p.doc_id", "k.k_cat")
    return class_counts_k() + f""",
scores AS (
  SELECT p.doc_id, p.category_id, p.subcategory_id,
         {cat} AS cat_prob, {fine("p.doc_id", "k.k_sub")} AS sub_prob
  FROM prepared p, k WHERE p.split = 'val'),
cmap AS (SELECT category_id, list_sort(list(DISTINCT subcategory_id)) AS sub_ids
         FROM prepared GROUP BY category_id)"""


TOKEN_RE = r"[\p{L}\p{N}_]+"


def tfidf(src: str = "prepared", min_df: int = 10, max_features: int = 200000) -> str:
    """tokens -> grams -> tf (per document) -> vocabulary on train -> idf -> weights."""
    return f"""toks AS (
  SELECT doc_id, category_id, subcategory_id, split,
         regexp_extract_all(strip_accents(lower(clean_description)), '{TOKEN_RE}') AS t
  FROM {src}),
grams AS (
  SELECT doc_id, category_id, subcategory_id, split,
         unnest(list_concat(t, list_transform(range(greatest(len(t) - 1, 0)),
                                              lambda i: t[i + 1] || ' ' || t[i + 2]))) AS term
  FROM toks),
tf AS (SELECT doc_id, category_id, subcategory_id, split, term, count(*) AS tf
       FROM grams GROUP BY ALL),
n_train AS (SELECT count(*) AS n FROM {src} WHERE split = 'train'),
vocab AS (
  SELECT term, df, total,
         ln((1 + (SELECT n FROM n_train)) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE split = 'train'
        GROUP BY term HAVING count(*) >= {min_df}
        ORDER BY total DESC, term LIMIT {max_features})),
w AS (SELECT tf.*, (1 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v USING (term)),
weights AS (SELECT doc_id, category_id, subcategory_id, split, term, tf,
                   w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
            FROM w)"""


def report(src: str, y: str, p: str, name: str) -> str:
    """Per-label report over truth ∪ prediction (zero on zero denominators)."""
    return f"""{name}_labels AS (SELECT {y} AS label FROM {src} UNION SELECT {p} FROM {src}),
{name}_counts AS (
  SELECT l.label,
         (SELECT count(*) FROM {src} WHERE {y} = l.label AND {p} = l.label) AS tp,
         (SELECT count(*) FROM {src} WHERE {y} = l.label) AS support,
         (SELECT count(*) FROM {src} WHERE {p} = l.label) AS predicted
  FROM {name}_labels l),
{name} AS (
  SELECT label, tp, support, predicted,
         CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
         CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + (predicted - tp) + (support - tp)) END AS f1
  FROM {name}_counts)"""


def keyword_stats(cls: str, name: str) -> str:
    """Term statistics of training documents for one level, as ``{name}_stats``; class sizes
    as ``{name}_ncls``; stand-in weights as ``{name}_w``."""
    return f"""{name}_pres AS (SELECT DISTINCT doc_id, {cls} AS class_id, term FROM tf
                 WHERE split = 'train' AND term IN (SELECT term FROM vocab)),
{name}_ncls AS (SELECT {cls} AS class_id, count(*) AS n_class FROM prepared
                WHERE split = 'train' GROUP BY 1),
{name}_sc AS (SELECT class_id, term, count(*) AS support_class FROM {name}_pres GROUP BY 1, 2),
{name}_st AS (SELECT term, count(*) AS support_total FROM {name}_pres GROUP BY 1),
{name}_stats AS (
  SELECT class_id, term, support_class, support_total, n_class,
         support_class / support_total AS dominance, support_class / n_class AS p_in_class
  FROM {name}_sc JOIN {name}_st USING (term) JOIN {name}_ncls USING (class_id)),
{name}_w AS (
  SELECT c.class_id, v.term,
         round(coalesce(s.dominance, 0.0) - c.n_class / (SELECT n FROM n_train), 6) AS weight
  FROM {name}_ncls c CROSS JOIN vocab v
  LEFT JOIN {name}_stats s ON s.class_id = c.class_id AND s.term = v.term),
{name}_cand AS (
  SELECT * FROM (SELECT class_id, 'include' AS direction, term, weight,
                        row_number() OVER (PARTITION BY class_id ORDER BY weight DESC, term) AS rank
                 FROM {name}_w) WHERE rank <= 40
  UNION ALL
  SELECT * FROM (SELECT class_id, 'exclude' AS direction, term, weight,
                        row_number() OVER (PARTITION BY class_id ORDER BY weight ASC, term) AS rank
                 FROM {name}_w) WHERE rank <= 40),
{name}_kw AS (
  SELECT c.class_id, c.direction, c.rank, c.term, c.weight,
         coalesce(s.support_class, 0) AS support_class,
         coalesce(s.support_class, 0) / t.support_total AS dominance
  FROM {name}_cand c
  JOIN {name}_st t ON t.term = c.term
  LEFT JOIN {name}_sc s ON s.class_id = c.class_id AND s.term = c.term
  WHERE (coalesce(s.support_class, 0) >= 3 AND coalesce(s.support_class, 0) / t.support_total >= 0.05)
     OR coalesce(s.support_class, 0) / t.support_total >= 0.5)"""
