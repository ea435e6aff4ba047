"""The same results as SQL, built up from common table expressions.

Written relationally on purpose (unnest, windows, joins) where the operators
work on arrays, hashes and cut-offs, so that the two sides share no method.
"""

from __future__ import annotations

from labelloom.functions.text import ENGLISH_STOP_WORDS

SPACE = r"\p{Z}\t-\r\x1c-\x1f\x{85}"
WORD = r"\p{L}\p{N}_"
FUSED = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


def clean(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern in (rf"http[^{SPACE}]+|www\.[^{SPACE}]+", rf"@[{WORD}]+", r"[^a-z]+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


def light(text: str) -> str:
    out = text
    for pattern, by in ((rf"https?://[^{SPACE}]+", ""), (rf"@[{WORD}]+", ""), ("#", ""), (rf"[{SPACE}]+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def fused(text: str) -> str:
    for head, tail in FUSED:
        text = rf"regexp_replace({text}, '\b{head}{tail}\b', '{head} {tail}', 'g')"
    return text


RULES = ", ".join(
    f"('{p}', {slot}, '{ending}', '{rep}')"
    for p, listed in (
        ("n", "s: ses:s ves:f xes:x zes:z ches:ch shes:sh men:man ies:y"),
        ("v", "s: ies:y es:e es: ed:e ed: ing:e ing:"),
    )
    for slot, (ending, rep) in enumerate((r.split(":") for r in listed.split()), 2)
)
CLASS = "CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END"
CORPUS = f"corpus AS (SELECT d.doc_id, d.text, d.n_chars, {CLASS} AS class FROM documents d JOIN labels l USING (doc_id))"
PARTLY = f"partly AS (SELECT d.*, CASE WHEN l.doc_id IS NULL THEN NULL ELSE {CLASS} END AS class FROM documents d LEFT JOIN labels l USING (doc_id))"


def words(source: str, key: str = "doc_id", text: str = "text") -> str:
    """``cleaned(key, t)``, ``words(key, w, p)`` and ``kept(key, w, pos)`` of a table."""
    return f"""
cleaned AS (SELECT {key}, {clean(text)} AS t FROM {source}),
split_words AS (SELECT {key}, string_split({fused('t')}, ' ') AS ws FROM cleaned WHERE t <> ''),
words AS (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM split_words),
kept AS (SELECT {key}, w, row_number() OVER (PARTITION BY {key} ORDER BY p) AS pos FROM words
         WHERE length(w) >= 2 AND w NOT IN ({STOP}))"""


GRAMS = """
grams AS (
  SELECT doc_id, w AS term, 0 AS kind, pos FROM kept
  UNION ALL
  SELECT doc_id, w || ' ' || nxt, 1, pos
  FROM (SELECT doc_id, w, pos, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM kept) WHERE nxt IS NOT NULL),
stats AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM grams GROUP BY term)"""


def vocab(rows: str = "corpus", k: int = 10_000, stats: str = "stats") -> str:
    return f"""
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, cf, df,
         ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf
  FROM (SELECT * FROM {stats} ORDER BY cf DESC, term LIMIT {k}), (SELECT count(*)::DOUBLE AS n FROM {rows}))"""


def tfidf_cte() -> str:
    return """
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
weighed AS (SELECT doc_id, term, idx, tf * idf AS w FROM tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM weighed)"""


def split(source: str = "corpus", label: str = "class") -> str:
    return f"""
sizes AS (SELECT {label}, count(*) AS c FROM {source} GROUP BY {label}),
totals AS (SELECT sum(c)::BIGINT AS n, sum(c)::BIGINT - CAST(ceil(CAST(0.2 AS DOUBLE) * sum(c)) AS BIGINT) AS train FROM sizes),
shares AS (SELECT {label}, (c * train) // n AS base, (c * train) % n AS rest, train FROM sizes, totals),
quota AS (SELECT {label}, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {label})
            <= train - sum(base) OVER () THEN 1 ELSE 0 END AS n_train FROM shares),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || doc_id), doc_id) AS r FROM {source}),
splitted AS (SELECT o.*, CASE WHEN r <= n_train THEN 'train' ELSE 'test' END AS split FROM ordered o JOIN quota USING ({label}))"""


# Three stand-in models: the data holds no predictions, so simple rules on the
# text length play their part.
STAND_IN = {
    "ByLength": "CASE WHEN n_chars % 5 = 0 THEN 0 WHEN n_chars % 3 = 0 THEN 1 ELSE 2 END",
    "AlwaysTwo": "2",
    "Mostly": "CASE WHEN n_chars % 4 = 0 THEN (class + 1) % 3 ELSE class END",
}
PREDICTIONS = "preds AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, {i} AS ordinal, doc_id, class, {rule} AS pred FROM corpus"
    for i, (name, rule) in enumerate(STAND_IN.items())
) + ")"
PER_CLASS = """
per_class AS (
  SELECT model, ordinal, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT model, ordinal, class AS label, 1 AS support, 0 AS predicted, CASE WHEN class = pred THEN 1 ELSE 0 END AS tp FROM preds
    UNION ALL SELECT model, ordinal, pred, 0, 1, 0 FROM preds) GROUP BY ALL),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS p,
                    CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS r FROM per_class),
scores AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM rates),
metrics AS (SELECT model, ordinal, sum(tp)::DOUBLE / sum(support) AS accuracy, sum(p * support) / sum(support) AS precision,
                   sum(r * support) / sum(support) AS recall, sum(f * support) / sum(support) AS f1 FROM scores GROUP BY ALL),
report AS (
  SELECT model, 0 AS ordinal, label, CAST(label AS VARCHAR) AS name, p AS precision, r AS recall, f AS f1, support FROM scores
  UNION ALL SELECT model, 1, NULL, 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support) FROM scores GROUP BY model
  UNION ALL SELECT model, 2, NULL, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores GROUP BY model
  UNION ALL SELECT model, 3, NULL, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), sum(support) FROM scores GROUP BY model)"""

LOGITS = "logits AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS z FROM embeddings)"
NLL = """
flat AS (SELECT vec_id, label, unnest(z) AS v, generate_subscripts(z, 1) - 1 AS j FROM logits),
nll AS (SELECT vec_id, label, ln(sum(exp(v - top))) + max(top) - max(CASE WHEN j = label THEN v END) AS nll
        FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM flat) GROUP BY vec_id, label)"""
VOTES = f"""
votes AS (SELECT doc_id, toxic * 3 AS hate_speech, (1 - quality) * 2 AS offensive_language,
                 quality * CAST(n_chars % 4 AS INTEGER) AS neither, {CLASS} AS class, n_chars
          FROM documents JOIN labels l USING (doc_id)),
voted AS (SELECT *, hate_speech + offensive_language + neither + CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS count,
                 greatest(hate_speech, offensive_language, neither) AS top FROM votes)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + " "


def fair(m: str, key: str) -> str:
    """How many of ``m`` draws fall on the first of two equal sides: set bits of digests, or the normal curve."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT".format
    ones = f"bit_count({number(f"{key} || ':' || word")} & ((1::BIGINT << least(60, {m} - 60 * word)) - 1))"
    radius = f"sqrt(-2 * ln(({number(f"{key} || ':radius'")} + 1) / 2.0::DOUBLE ** 60))"
    normal = f"{radius} * cos(2 * pi() * ({number(f"{key} || ':angle'")} / 2.0::DOUBLE ** 60))"
    return f"""CASE WHEN {m} <= 0 THEN 0 WHEN {m} <= 960 THEN list_sum(list_transform(range(0, ({m} + 59) // 60), lambda word: {ones}))::BIGINT
        ELSE greatest(0, least({m}, floor({m} / 2.0::DOUBLE + sqrt({m}) / 2 * {normal} + 0.5)::BIGINT)) END"""


def oracle_sql() -> dict[str, str]:
    """SQL text per query name."""
    profile = """SELECT class, count(*) AS n, sum(CASE WHEN t = '' THEN 1 ELSE 0 END)::BIGINT AS n_empty,
        round(sum(CASE WHEN t = '' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS empty_rate,
        round(avg(coalesce(k, 0)), 6) AS mean_tokens, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share_pct
        FROM corpus JOIN cleaned USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM kept GROUP BY doc_id) USING (doc_id)
        GROUP BY class ORDER BY class"""
    joined = "coalesce(string_agg(w, ' ' ORDER BY {o}), '')"
    content = f"SELECT c.doc_id, {joined.format(o='pos')} AS text_clean FROM cleaned c LEFT JOIN kept USING (doc_id) GROUP BY c.doc_id"
    tfidf = _with(CORPUS, words("corpus"), GRAMS, vocab(), tfidf_cte()) + "SELECT doc_id, term, idx, round(tfidf, 6) AS tfidf FROM tfidf"
    dictionary = """
lemma_source AS (SELECT DISTINCT w FROM words WHERE length(w) > 3),
lemmas AS (SELECT w AS surface, 'n' AS pos, left(w, length(w) - 1) AS lemma FROM lemma_source WHERE w LIKE '%s'
           UNION ALL SELECT w, 'v', left(w, length(w) - 3) FROM lemma_source WHERE w LIKE '%ing')"""
    lemmatized = f"""SELECT c.doc_id, coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY k.pos), '') AS lemmas FROM cleaned c
        LEFT JOIN kept k USING (doc_id) LEFT JOIN lemmas l ON l.surface = w AND l.pos = {{pos}} GROUP BY c.doc_id"""
    encoded = """
numbered AS (SELECT doc_id, pos, coalesce(idx + 2, 1) AS id FROM kept LEFT JOIN vocab ON term = w WHERE pos <= 128),
ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids, count(*) AS n FROM numbered GROUP BY doc_id)"""
    padded = """array_to_string(list_concat(coalesce(ids, []), [0 FOR x IN range(0, 128 - coalesce(n, 0))]), ' ') AS input_ids,
        array_to_string(list_concat([1 FOR x IN range(0, coalesce(n, 0))], [0 FOR x IN range(0, 128 - coalesce(n, 0))]), ' ') AS attention_mask"""
    rounded = "round(accuracy, {d}) AS accuracy, round(precision, {d}) AS precision, round(recall, {d}) AS recall, round(f1, {d}) AS f1"
    report = _with(CORPUS, PREDICTIONS, PER_CLASS)
    cell = "lpad(coalesce(CASE WHEN {m} IS NOT NULL THEN printf('%.2f', {m}) END, ''), 9, ' ')"
    row = "lpad(name, 12, ' ') || '  ' || " + " || ' ' || ".join(cell.format(m=m) for m in ("precision", "recall", "f1"))
    losses = _with(LOGITS, NLL, "counted AS (SELECT label, count(*)::DOUBLE AS c FROM embeddings GROUP BY label)",
                   "weights AS (SELECT label, (1 / c) / sum(1 / c) OVER () * count(*) OVER () AS weight FROM counted)")
    oversampled = """
train AS (SELECT doc_id, class FROM splitted WHERE split = 'train'),
t_sizes AS (SELECT class, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM train GROUP BY class),
t_ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rk FROM train),
powers AS (SELECT *, n & ((1::BIGINT << (k + 1)) - 1) AS whole, row_number() OVER (PARTITION BY class ORDER BY k DESC) AS ord,
    count(*) OVER (PARTITION BY class) AS blocks FROM (SELECT class, n, need, unnest(range(0, 62)) AS k FROM t_sizes WHERE need > 0)
    WHERE n & (1::BIGINT << k) > 0),
walk AS (SELECT class, 1::BIGINT AS ord, 1::BIGINT AS step, need::BIGINT AS rest, need::BIGINT AS open, 0::BIGINT AS taken, 1::BIGINT << k AS x
        FROM powers WHERE ord = 1
    UNION ALL SELECT class, ord + (open = 0)::INT, CASE WHEN open = 0 THEN 1 ELSE step + 1 END,
        CASE WHEN open = 0 THEN rest - taken ELSE rest END,
        CASE WHEN open = 0 THEN rest - taken WHEN 2 * x >= whole THEN open - zeros ELSE zeros END,
        CASE WHEN open = 0 THEN 0 WHEN 2 * x >= whole THEN taken + zeros ELSE taken END,
        CASE WHEN open = 0 THEN next_size WHEN 2 * x >= whole THEN 2 * x - whole ELSE 2 * x END
        FROM (SELECT w.*, p.whole, q.size AS next_size, {zeros} AS zeros FROM walk w JOIN powers p USING (class, ord)
              LEFT JOIN (SELECT class, ord - 1 AS ord, 1::BIGINT << k AS size FROM powers) q USING (class, ord)
              WHERE w.ord < p.blocks AND w.step <= 129)),
block_draws AS (SELECT w.class, p.k, (p.n - p.whole) >> p.k AS node, CASE WHEN w.ord = p.blocks THEN w.rest ELSE w.taken END AS m
    FROM walk w JOIN powers p USING (class, ord) WHERE w.open = 0 OR (w.ord = p.blocks AND w.step = 1)),
tree AS (SELECT class, k, node, m FROM block_draws WHERE m > 0
    UNION ALL SELECT class, k - 1, 2 * node + side, CASE WHEN side = 0 THEN heads ELSE m - heads END
        FROM (SELECT *, {heads} AS heads, unnest([0, 1]) AS side FROM tree WHERE k > 0 AND m > 0)),
taken AS (SELECT class, node AS rk, m FROM tree WHERE k = 0)"""
    oversampled = oversampled.format(zeros=fair("w.open", "'42:' || class || ':block:' || k || ':' || step"),
                                     heads=fair("m", "'42:' || class || ':' || k || ':' || node"))
    narrow_words = f"""
pairs AS (SELECT doc_id, class AS label, {light('text')} AS text FROM corpus),
{split('pairs', 'label').strip()},
raw_words AS (SELECT doc_id, split, string_split(lower(text), ' ') AS ws FROM splitted WHERE text <> ''),
kept AS (SELECT doc_id, split, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM raw_words),
stats AS (SELECT w AS term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM kept WHERE split = 'train' GROUP BY w)"""
    docs_words = words("documents")
    out = {
        "label_text_profile": _with(CORPUS, words("corpus")) + profile,
        "resolve_columns": f"""WITH {CORPUS}
            SELECT 'corpus' AS source, 'wide' AS profile, 'Tweet' AS text_column, 'Class' AS label_column, count(*) AS n,
                   sum(length(text))::BIGINT AS text_chars, sum(class)::BIGINT AS label_sum FROM corpus
            UNION ALL SELECT 'corpus', 'narrow', 'Tweet', 'Class', count(*), sum(length(text))::BIGINT, sum(class)::BIGINT FROM corpus
            UNION ALL SELECT 'conversations', 'wide', 'text', 'conv_id', count(*), sum(length(text))::BIGINT, sum(conv_id)::BIGINT FROM conversations
            UNION ALL SELECT 'conversations', 'narrow', 'text', 'conv_id', count(*), sum(length(text))::BIGINT, sum(conv_id)::BIGINT FROM conversations
            UNION ALL SELECT 'pages', 'wide', 'url', 'page_id', count(*), sum(length(url))::BIGINT, sum(page_id)::BIGINT FROM pages
            UNION ALL SELECT 'pages', 'narrow', 'url', 'page_id', count(*), sum(length(url))::BIGINT, sum(page_id)::BIGINT FROM pages""",
        "to_text_label": f"WITH {PARTLY} SELECT doc_id, text, CAST(class AS INTEGER) AS label FROM partly WHERE class IS NOT NULL AND text IS NOT NULL",
        "drop_null_labels": f"WITH {PARTLY} SELECT source, count(*) AS n FROM partly WHERE class IS NOT NULL GROUP BY source",
        "null_text_to_empty": "SELECT d.doc_id, c.turn, coalesce(c.text, '') AS text FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id",
        "reuse_or_clean": _with(docs_words) + f"""SELECT t.doc_id, t.text_clean AS recomputed, lower(d.text) AS reused
            FROM ({content}) t JOIN documents d USING (doc_id)""",
        "keep_columns": "SELECT doc_id, lang, n_chars FROM documents",
        "label_names": "SELECT label, CASE label WHEN 0 THEN 'Hate Speech' WHEN 1 THEN 'Offensive' WHEN 2 THEN 'Neutral' ELSE CAST(label AS VARCHAR) END AS name FROM (SELECT DISTINCT label FROM embeddings) ORDER BY label",
        "vote_check": _with(VOTES) + """SELECT doc_id, tied, CASE WHEN NOT tied THEN first END AS majority, NOT tied AND first <> class AS label_differs,
            hate_speech + offensive_language + neither <> count AS votes_differ, count < 3 AS few_annotators FROM (
            SELECT *, (hate_speech = top)::INT + (offensive_language = top)::INT + (neither = top)::INT > 1 AS tied,
            CASE WHEN hate_speech = top THEN 0 WHEN offensive_language = top THEN 1 ELSE 2 END AS first FROM voted)""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS text_clean FROM documents",
        "clean_text_pages": f"SELECT page_id, {clean('html')} AS html_clean, {clean('url')} AS url_clean FROM pages",
        "light_clean": f"SELECT doc_id, {light('text')} AS text_light FROM documents",
        "light_clean_pages": f"SELECT page_id, {light('html')} AS html_light, {light('url')} AS url_light FROM pages",
        "tokenize": _with(docs_words) + f"SELECT c.doc_id, count(w) AS n_tokens, {joined.format(o='p')} AS tokens FROM cleaned c LEFT JOIN words USING (doc_id) GROUP BY c.doc_id",
        "remove_stopwords": _with(docs_words) + f"SELECT c.doc_id, {joined.format(o='p')} AS kept FROM cleaned c LEFT JOIN (SELECT * FROM words WHERE w NOT IN ({STOP})) USING (doc_id) GROUP BY c.doc_id",
        "remove_stopwords_table": _with(docs_words, f"stop AS (SELECT DISTINCT unnest(string_split({fused(clean('text'))}, ' ')) AS word FROM benchmark)")
        + f"SELECT c.doc_id, {joined.format(o='p')} AS kept FROM cleaned c LEFT JOIN (SELECT * FROM words WHERE w NOT IN (SELECT word FROM stop)) USING (doc_id) GROUP BY c.doc_id",
        "min_token_length": _with(docs_words) + f"SELECT c.doc_id, {joined.format(o='p')} AS kept FROM cleaned c LEFT JOIN (SELECT * FROM words WHERE length(w) >= 4) USING (doc_id) GROUP BY c.doc_id",
        "content_tokens": _with(docs_words) + content,
        "lemmatize": _with(docs_words, dictionary) + lemmatized.format(pos="CASE WHEN w LIKE '%ing' THEN 'v' ELSE 'n' END"),
        "prepare_documents_tagged": _with(docs_words, dictionary) + lemmatized.format(pos="CASE WHEN w LIKE '%ing' THEN 'v' ELSE 'n' END"),
        "lemmatize_by_rule": _with(docs_words, f"rules(p, slot, ending, rep) AS (VALUES {RULES})") + """,
            toks AS (SELECT DISTINCT w, CASE WHEN w LIKE '%ing' THEN 'v' ELSE 'n' END AS p FROM kept),
            known AS (SELECT w AS c FROM toks WHERE length(w) > 2),
            tried AS (SELECT w, p, 1 AS slot, w AS c FROM toks
                      UNION ALL SELECT w, p, slot, left(w, length(w) - length(ending)) || rep FROM toks JOIN rules USING (p) WHERE w LIKE '%' || ending),
            good AS (SELECT w, p, slot, c FROM tried WHERE c IN (SELECT c FROM known) AND (slot = 1 OR p = 'v' OR w NOT LIKE '%ses')
                     UNION ALL SELECT w, p, 0, left(w, 3) FROM toks WHERE p = 'n' AND w LIKE '%ses'),
            chosen AS (SELECT w, arg_min(c, length(c) * 100 + slot) AS lemma FROM good GROUP BY w)
            SELECT c.doc_id, coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY k.pos), '') AS lemmas FROM cleaned c
            LEFT JOIN kept k USING (doc_id) LEFT JOIN chosen USING (w) GROUP BY c.doc_id""",
        "lemmatize_nouns": _with(docs_words, dictionary) + lemmatized.format(pos="'n'"),
        "ngrams": _with(docs_words, GRAMS) + """SELECT c.doc_id, count(term) AS n_terms, coalesce(string_agg(term, '|' ORDER BY kind, pos), '') AS terms
            FROM cleaned c LEFT JOIN grams USING (doc_id) GROUP BY c.doc_id""",
        "encode_fixed_length": _with(CORPUS, words("corpus"), "stats AS (SELECT w AS term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM kept GROUP BY w)", vocab(), encoded)
        + f"SELECT doc_id, {padded} FROM corpus LEFT JOIN ids USING (doc_id)",
        "argmax": _with(LOGITS) + "SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred FROM logits",
        "softmax_nll": _with(LOGITS, NLL) + "SELECT vec_id, round(nll, 6) AS nll FROM nll",
        "weighted_cross_entropy": losses + """SELECT 'plain' AS kind, round(avg(nll), 6) AS loss FROM nll
            UNION ALL SELECT 'weighted', round(sum(weight * nll) / sum(weight), 6) FROM nll JOIN weights USING (label)""",
        "logit_metrics": _with("preds AS (SELECT 'm' AS model, 0 AS ordinal, label AS class, list_position(z, list_max(z)) - 1 AS pred FROM (SELECT label, embedding AS z FROM embeddings))", PER_CLASS)
        + f"SELECT {rounded.format(d=6)} FROM metrics",
        "class_distribution": f"WITH {PARTLY} SELECT class, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share_pct FROM partly WHERE class IS NOT NULL GROUP BY class",
        "class_distribution_first_seen": "SELECT role, count(*) AS n, min(conv_id) AS first_seen, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share_pct FROM conversations WHERE role IS NOT NULL GROUP BY role",
        "empty_text_rate": _with(words("conversations", "conv_id, turn"))
        + """SELECT count(*) AS n, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_empty, round(sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS empty_rate
            FROM cleaned LEFT JOIN (SELECT conv_id, turn, count(*) AS k FROM kept GROUP BY ALL) USING (conv_id, turn)""",
        "row_counts": _with(CORPUS, split()) + "SELECT split, count(*) AS n FROM splitted GROUP BY split UNION ALL SELECT 'all', count(*) FROM splitted",
        "term_stats": _with(docs_words, GRAMS) + "SELECT term, cf, df FROM stats",
        "confusion_matrix": f"""WITH {CORPUS}, {PREDICTIONS}, used AS (SELECT class AS l FROM preds UNION SELECT pred FROM preds)
            SELECT a.l AS label, b.l AS pred, count(p.doc_id) AS n FROM used a CROSS JOIN used b
            LEFT JOIN (SELECT * FROM preds WHERE model = 'AlwaysTwo') p ON p.class = a.l AND p.pred = b.l GROUP BY a.l, b.l""",
        "confusion_wide": f"""WITH {CORPUS}, {PREDICTIONS} SELECT class AS label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1,
            count(*) FILTER (pred = 2) AS pred_2 FROM preds WHERE model = 'ByLength' GROUP BY class""",
        "per_class_report": report + "SELECT model, ordinal, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM report",
        "weighted_metrics": report + f"SELECT model, {rounded.format(d=6)} FROM metrics",
        "report_text": report + f"""SELECT {row} || ' ' || lpad(CAST(support::BIGINT AS VARCHAR), CAST(greatest(9, length(CAST(support::BIGINT AS VARCHAR))) AS INTEGER), ' ') AS value FROM report WHERE model = 'Mostly'
            UNION ALL SELECT '' UNION ALL SELECT '' UNION ALL SELECT lpad('', 12, ' ') || '  ' || lpad('precision', 9, ' ') || ' ' || lpad('recall', 9, ' ') || ' ' || lpad('f1-score', 9, ' ') || ' ' || lpad('support', 9, ' ')""",
        "distinct_labels": "SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL ORDER BY role",
        "compare_models": report + f"SELECT model, {rounded.format(d=4)} FROM metrics",
        "select_best": report + "SELECT model, round(f1, 6) AS f1 FROM metrics ORDER BY metrics.f1 DESC, ordinal LIMIT 1",
        "fit_vocabulary": _with(CORPUS, words("corpus"), GRAMS, vocab()) + "SELECT term, idx, cf, df FROM vocab",
        "vocabulary_summary": _with(CORPUS, words("corpus"), GRAMS, vocab(k=50)) + "SELECT term, idx, cf, df FROM vocab",
        "vectorizer_tokens": r"""SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens
            FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents)""",
        "reused_text_vocabulary": r"""SELECT w AS term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower('Two  SPACES a u, ' || text), '[\p{L}\p{N}_]{2,}')) AS w
            FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) GROUP BY w""",
        "fit_idf": _with(CORPUS, words("corpus"), GRAMS, vocab()) + "SELECT term, round(idf, 6) AS idf FROM vocab",
        "tfidf": tfidf,
        "tfidf_joined": tfidf,
        "tfidf_train_fit": _with(CORPUS, split(), words("corpus"), GRAMS.replace("stats AS", "all_stats AS"),
            "train_rows AS (SELECT doc_id FROM splitted WHERE split = 'train')",
            "stats AS (SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM grams WHERE doc_id IN (SELECT doc_id FROM train_rows) GROUP BY term)",
            vocab("train_rows"), tfidf_cte()) + "SELECT doc_id, term, idx, round(tfidf, 6) AS tfidf FROM tfidf",
        "to_vectors": _with(CORPUS, words("corpus"), GRAMS, vocab(), tfidf_cte())
        + "SELECT doc_id, count(idx) AS n_terms, round(sqrt(sum(tfidf * tfidf)), 6) AS norm FROM tfidf GROUP BY doc_id",
        "vectorize": _with(CORPUS, words("corpus"), GRAMS, vocab(), tfidf_cte())
        + "SELECT doc_id, count(idx) AS n_terms, round(coalesce(sqrt(sum(tfidf * tfidf)), 0), 6) AS norm FROM corpus LEFT JOIN tfidf USING (doc_id) GROUP BY doc_id",
        "vectorize_joined": _with(CORPUS, words("corpus"), GRAMS, vocab(), tfidf_cte())
        + "SELECT doc_id, count(idx) AS n_terms, round(coalesce(sqrt(sum(tfidf * tfidf)), 0), 6) AS norm FROM corpus LEFT JOIN tfidf USING (doc_id) GROUP BY doc_id",
        "stratified_split": _with(CORPUS, split()) + "SELECT doc_id, class, split FROM splitted",
        "balanced_weights": _with(CORPUS, split()) + """SELECT class, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight
            FROM splitted WHERE split = 'train' GROUP BY class""",
        "inverse_frequency_weights": _with(CORPUS, split(), "c AS (SELECT class, count(*) AS n FROM splitted WHERE split = 'train' GROUP BY class)")
        + "SELECT class, n, round((1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER () * count(*) OVER (), 6) AS weight FROM c",
        "random_oversample": _with(CORPUS, split(), oversampled).replace("WITH", "WITH RECURSIVE", 1)
        + "SELECT doc_id, class, 1 + coalesce(m, 0) AS copies FROM t_ranked LEFT JOIN taken USING (class, rk)",
        "dense_label_index": "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM documents",
        "score_with": f"WITH {CORPUS} SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 0 WHEN n_chars % 3 = 0 THEN 1 ELSE 2 END AS pred FROM corpus",
        "csv_round_trip": f"WITH {CORPUS} SELECT doc_id, text, class FROM corpus",
        "csv_quoted_split": f"WITH {CORPUS} SELECT doc_id, text, class FROM corpus",
        "first_existing": "SELECT count(*) AS n FROM documents",
        "head_sample": f"WITH {CORPUS} SELECT doc_id, class FROM corpus ORDER BY doc_id LIMIT 50",
        "artifact_round_trip": f"WITH {CORPUS}, c AS (SELECT class, count(*) AS n FROM corpus GROUP BY class) "
        + " UNION ALL ".join(f"SELECT '{fmt}' AS format, class, n FROM c" for fmt in ("csv", "json", "parquet")),
        "read_metrics": report + f"SELECT model, {rounded.format(d=6)} FROM metrics",
        "fixed_length_job": _with(CORPUS, narrow_words, vocab("splitted WHERE split = 'train'"), encoded)
        + f"SELECT s.doc_id, s.split, s.label, {padded} FROM splitted s LEFT JOIN ids USING (doc_id)",
        "fixed_length_counts": _with(CORPUS, "pairs AS (SELECT doc_id, class AS label FROM corpus WHERE text IS NOT NULL)", split("pairs", "label"))
        + """SELECT 'split' AS kind, split AS name, count(*) AS n FROM splitted GROUP BY split UNION ALL SELECT 'split', 'all', count(*) FROM splitted
            UNION ALL SELECT 'label', CAST(label AS VARCHAR), count(*) FROM splitted GROUP BY label""",
        "run_path": f"""WITH {CORPUS} SELECT class, n, kind, name FROM (SELECT class, count(*) AS n FROM corpus GROUP BY class),
            (VALUES ('free', 'run'), ('taken', 'run_20240102T030405Z'), ('forced', 'run'), ('shared', 'run'),
                    ('unnamed', 'run_20240102T030405Z')) v(kind, name)""",
        "run_config": f"WITH {CORPUS} SELECT '128' AS max_length, '42' AS seed, count(DISTINCT class) AS num_labels FROM corpus",
        "evaluate_and_compare": report + f"SELECT model, {rounded.format(d=4)} FROM metrics",
        "train_logistic": _with(CORPUS, split())
        + "SELECT class, count(*) AS n, round(1.0::DOUBLE / count(*) OVER (), 2) AS share FROM splitted WHERE split = 'train' GROUP BY class",
        "train_oversampled_logistic": _with(CORPUS, split())
        + "SELECT class, max(count(*)) OVER () AS n, round(1.0::DOUBLE / count(*) OVER (), 2) AS share FROM splitted WHERE split = 'train' GROUP BY class",
        "train_linear_svm": _with(CORPUS, split())
        + "SELECT count(*) AS n, count(DISTINCT class) AS classes, true AS beats_majority FROM splitted WHERE split = 'train'",
        "logistic_optimum": _with(CORPUS, split())
        + "SELECT count(*) AS n, count(DISTINCT class) AS classes, true AS at_optimum FROM splitted WHERE split = 'train'",
        "svm_optimum": _with(CORPUS, split())
        + "SELECT count(*) AS n, count(DISTINCT class) AS classes, true AS at_optimum FROM splitted WHERE split = 'train'",
        "train_and_compare": _with(CORPUS, split())
        + """SELECT 3::BIGINT AS models, 3 * count(*) AS predictions, 1::BIGINT AS best, 3::BIGINT AS recall_is_accuracy,
            true AS best_has_top_f1 FROM splitted WHERE split = 'test'""",
        "score": _with(CORPUS, split()) + "SELECT count(*) AS n, 0::BIGINT AS differing FROM splitted WHERE split = 'test'",
        "save_and_load_model": "SELECT count(*) AS n, 0::BIGINT AS differing FROM documents",
        "score_batches": "SELECT count(*) AS n, 0::BIGINT AS differing, count(DISTINCT doc_id) AS docs, 2::BIGINT AS versions FROM documents",
        "score_stream": "SELECT count(*) AS n, 0::BIGINT AS differing FROM documents",
        "clean_stream": _with(docs_words) + content,
    }
    return out
