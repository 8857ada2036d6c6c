"""The registered queries as plain SQL, to check results against."""

from __future__ import annotations

from reviewloom.functions.constants import (
    NO_KEYWORDS,
    STOPWORDS,
    SUMMARY_SENTENCE,
    WHITESPACE_CODE_POINTS,
)
from reviewloom.operators.epochs import SCALE, rate_at
from reviewloom.operators.hierarchy import MIN_SAMPLES
from reviewloom.operators.naive_bayes import SMOOTHING
from reviewloom.operators.word_vectors import MIN_COUNT, WINDOW
from reviewloom.plans.catalog import CLUSTER_ROWS, HEIGHTS, K, RECIPE, SAMPLE_ROWS, SLOTS, TOPIC_ROWS
from reviewloom.sources.testdata import SCORES

WS = "(" + " || ".join(f"chr({int(p, 16)})" for p in WHITESPACE_CODE_POINTS.split()) + ")"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
W = r"[\p{L}\p{N}_]"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def dot(a: str, b: str) -> str:
    return f"round({DOT.format(a=a, b=b)}, 9)"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{W}+')"


def escape(text: str) -> str:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{char}', '{entity}')"
    return out


RAW = f"""raw AS (
  SELECT d.doc_id AS Id, d.text AS Text,
         CASE WHEN d.source <> 'src0' THEN concat('Review from ', d.source) END AS Summary,
         {SCORES} AS Score,
         CASE WHEN l.quality IS NULL THEN 0 ELSE l.quality END AS HelpfulnessNumerator,
         1 AS HelpfulnessDenominator, d.source AS source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
CLEAN = f"""{RAW}, clean AS (
  SELECT * FROM (
    SELECT Id AS review_id, trim(Text, {WS}) AS text, Summary AS summary, Score,
           HelpfulnessNumerator, HelpfulnessDenominator,
           CASE WHEN Score IN (1, 2) THEN 0 WHEN Score IN (4, 5) THEN 1 END AS label, source
    FROM raw WHERE Text IS NOT NULL AND Score IS NOT NULL)
  WHERE label IS NOT NULL AND length(text) > 20)"""
CORPUS = f"""{CLEAN}, corpus AS (
  SELECT review_id, text, summary, Score, HelpfulnessNumerator, HelpfulnessDenominator, label
  FROM clean WHERE length(text) > 30)"""
INDEX = f"""{CORPUS}, lengths AS (
  SELECT vec_id, embedding,
         sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len
  FROM embeddings), idx AS (
  SELECT vec_id AS review_id,
         list_transform(embedding, lambda x: CASE WHEN len = 0 THEN x ELSE (x::DOUBLE / len)::FLOAT END) AS embedding
  FROM lengths WHERE vec_id IN (SELECT review_id FROM corpus))"""
MEAN = f"""{INDEX}, cells AS (
  SELECT unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), means AS (
  SELECT pos, avg(x) AS m FROM cells GROUP BY pos), mean_vector AS (
  SELECT list(m / (SELECT sqrt(sum(m * m)) FROM means) ORDER BY pos) AS v FROM means), scored AS (
  SELECT review_id, {dot('embedding', 'v')} AS score FROM idx, mean_vector)"""
TFIDF = f"""{CORPUS}, counts AS (
  SELECT review_id, word, count(*) AS tf
  FROM (SELECT review_id, unnest({words('text')}) AS word FROM corpus) GROUP BY ALL), idf AS (
  SELECT word, ln(((SELECT count(*) FROM corpus) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM counts GROUP BY word), dw AS (
  SELECT review_id, word, tf * idf AS w FROM counts JOIN idf USING (word)), dn AS (
  SELECT review_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY review_id), qw AS (
  SELECT query_id, word, tf * idf AS w
  FROM (SELECT query_id, word, count(*) AS tf
        FROM (SELECT item_id AS query_id, unnest({words('text')}) AS word FROM benchmark) GROUP BY ALL)
  JOIN idf USING (word)), qn AS (
  SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id), pairs AS (
  SELECT query_id, review_id, round(sum(dw.w / dn.n * (qw.w / qn.n)), 9) AS score
  FROM dw JOIN dn USING (review_id) JOIN qw USING (word) JOIN qn USING (query_id)
  WHERE dn.n > 0 AND qn.n > 0 GROUP BY ALL), ranked AS (
  SELECT query_id, review_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id)::INTEGER AS rank
  FROM pairs WHERE score > 0)"""
HITS = f"""{TFIDF}, hits AS (
  SELECT query_id, rank, ranked.score AS score, review_id, summary, text AS review, corpus.Score::INTEGER AS rating
  FROM ranked JOIN corpus USING (review_id) WHERE rank <= {K})"""
HIT_WORDS = f"""{HITS}, tokens AS (
  SELECT query_id, rank, unnest(toks) AS word, unnest(generate_series(0, len(toks) - 1)) AS pos
  FROM (SELECT query_id, rank, list_filter({words('review')},
               lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({STOP})) AS toks FROM hits)), kw AS (
  SELECT query_id, word, count(*) AS count,
         row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank * 1000000 + pos))::INTEGER AS rank
  FROM tokens GROUP BY query_id, word)"""
TOPICS = f"""{CLEAN}, given AS (
  SELECT review_id, text, source FROM clean), sizes AS (
  SELECT source, count(*) AS rows, min(review_id) AS first FROM given GROUP BY source HAVING count(*) >= 20), numbers AS (
  SELECT source, row_number() OVER (ORDER BY rows DESC, first)::INTEGER - 1 AS topic FROM sizes), topics AS (
  SELECT review_id, text, coalesce(topic, -1)::INTEGER AS topic FROM given LEFT JOIN numbers USING (source)), counts AS (
  SELECT topic, word, count(*) AS tf
  FROM (SELECT topic, unnest(list_filter({words('text')}, lambda w: length(w) >= 2)) AS word FROM topics)
  GROUP BY ALL), per_topic AS (
  SELECT topic, sum(tf) AS n FROM counts GROUP BY topic), per_word AS (
  SELECT word, sum(tf) AS f FROM counts GROUP BY word), weights AS (
  SELECT topic, word,
         round(tf::DOUBLE / n * ln(1.0 + (SELECT floor(avg(n)) FROM per_topic) / f::DOUBLE), 9) AS weight
  FROM counts JOIN per_topic USING (topic) JOIN per_word USING (word)), top_words AS (
  SELECT topic, word, weight,
         row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word)::INTEGER AS rank FROM weights), info AS (
  SELECT t.topic, t.count, CASE WHEN n.name IS NULL THEN t.topic::VARCHAR ELSE concat_ws('_', t.topic::VARCHAR, n.name) END AS name
  FROM (SELECT topic, count(*) AS count FROM topics GROUP BY topic) t
  LEFT JOIN (SELECT topic, string_agg(word, '_' ORDER BY rank) AS name FROM top_words WHERE rank <= 4 GROUP BY topic) n
  USING (topic))"""
BATCH = f"""WITH {INDEX}, scored AS (
  SELECT e.vec_id AS query_id, review_id, {dot('idx.embedding', 'e.embedding')} AS score FROM idx, embeddings e)
SELECT * FROM (SELECT query_id, review_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id)::INTEGER AS rank FROM scored) WHERE rank <= 10"""
RULE = """rule AS (
  SELECT doc_id, quality AS label, 0.4::DOUBLE + toxic * 0.3::DOUBLE AS s0, n_chars / 2000.0::DOUBLE AS s1, n_chars, lang,
         CASE WHEN n_chars / 2000.0::DOUBLE > 0.4::DOUBLE + toxic * 0.3::DOUBLE THEN 1 ELSE 0 END AS prediction,
         md5(concat('42:', doc_id)) AS h
  FROM documents JOIN labels USING (doc_id))"""
SPLIT = "CASE WHEN h < 'cccccccc' THEN 'train' WHEN h < 'e6666666' THEN 'validation' ELSE 'test' END"
CLEAN_COLUMNS = "review_id, text, summary, Score, HelpfulnessNumerator, HelpfulnessDenominator, label"

DENSITY = f"""WITH RECURSIVE near AS (
  SELECT a.vec_id AS a, b.vec_id AS b, {dot('a.embedding', 'b.embedding')} AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), close AS (
  SELECT * FROM near WHERE score >= 0.3), core AS (
  SELECT a AS id FROM close GROUP BY a HAVING count(*) >= 5), links AS (
  SELECT a, b FROM close WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (
  SELECT id AS node, id AS seen FROM core
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen), component AS (
  SELECT node, min(seen) AS root FROM reach GROUP BY node), border AS (
  SELECT a AS node, b AS core, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n
  FROM close WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), placed AS (
  SELECT node, root FROM component
  UNION ALL
  SELECT border.node, component.root FROM border JOIN component ON component.node = border.core WHERE n = 1), sizes AS (
  SELECT root, count(*) AS rows, min(node) AS first FROM placed GROUP BY root HAVING count(*) >= 20), numbers AS (
  SELECT root, row_number() OVER (ORDER BY rows DESC, first)::INTEGER - 1 AS topic FROM sizes)
SELECT vec_id AS review_id, coalesce(topic, -1)::INTEGER AS topic
FROM embeddings LEFT JOIN placed ON placed.node = vec_id LEFT JOIN numbers USING (root)"""

HIERARCHY = f"""WITH RECURSIVE far AS (
  SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.embedding = b.embedding THEN 0
         ELSE round(1 - {dot('a.embedding', 'b.embedding')}, 9) END AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), cores AS (
  SELECT a AS id, d AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS n FROM far) WHERE n = {MIN_SAMPLES}), reach AS (
  SELECT a, b, greatest(d, x.core, y.core) AS d FROM far JOIN cores x ON x.id = a JOIN cores y ON y.id = b), heights AS (
  SELECT unnest(range({len(HEIGHTS)}))::INTEGER AS level, unnest({HEIGHTS}) AS h), seen AS (
  SELECT level, h, id AS node, id AS seen FROM heights JOIN cores ON core <= h
  UNION
  SELECT s.level, s.h, s.node, r.b FROM seen s JOIN reach r ON r.a = s.seen AND r.d <= s.h)
SELECT node AS review_id, level, min(seen) AS component FROM seen GROUP BY node, level"""

PMI = f"""WITH {CORPUS}, listed AS (SELECT review_id, {words('text')} AS ws FROM corpus), toks AS (
  SELECT review_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS pos FROM listed), vocab AS (
  SELECT w FROM toks GROUP BY w HAVING count(*) >= {MIN_COUNT}), next_to AS (
  SELECT review_id, w AS a, unnest([{", ".join(f"lead(w, {d}) OVER t" for d in range(1, WINDOW + 1))}]) AS b
  FROM toks WINDOW t AS (PARTITION BY review_id ORDER BY pos)), met AS (
  SELECT a, b, count(*) AS n FROM next_to WHERE b IS NOT NULL AND a IN (FROM vocab) AND b IN (FROM vocab) GROUP BY ALL), pairs AS (
  SELECT word, context, sum(n)::BIGINT AS n FROM (
    SELECT a AS word, b AS context, n FROM met UNION ALL SELECT b, a, n FROM met WHERE a <> b) GROUP BY ALL), sums AS (
  SELECT word, sum(n)::DOUBLE AS s FROM pairs GROUP BY word)
SELECT * FROM (SELECT p.word, p.context, p.n, round(ln(p.n * (SELECT sum(s) FROM sums) / (x.s * y.s)), 9) AS pmi
  FROM pairs p JOIN sums x ON x.word = p.word JOIN sums y ON y.word = p.context) WHERE pmi > 0"""

# Whole-word matches share their delimiters, so marking takes two passes.
TERMS = f"""list_transform(list_sort(list_transform(
    list_filter(list_distinct_ordered, lambda w: length(w) >= 2), lambda w, i: [lpad((100000 - length(w))::VARCHAR, 6, '0'), lpad(i::VARCHAR, 6, '0'), w])),
  lambda r: r[3])"""
FIRST_SEEN = f"list_filter(ws, lambda w, i: list_position(ws, w) = i)"
QUERY_TERMS = f"""terms AS (
  SELECT query_id, {TERMS.replace('list_distinct_ordered', 'firsts')} AS terms
  FROM (SELECT query_id, {FIRST_SEEN} AS firsts FROM (SELECT item_id AS query_id, {words('text')} AS ws FROM benchmark)))"""
MARK_1, MARK_2 = "chr(57344)", "chr(57345)"


def _mark(text: str) -> str:
    """One marking pass over unescaped text; marked words border on marks and are skipped."""
    pattern = (
        f"concat('(?i)(^|[^\\p{{L}}\\p{{N}}_', {MARK_1}, '])(', array_to_string(terms, '|'),"
        f" ')($|[^\\p{{L}}\\p{{N}}_', {MARK_2}, '])')"
    )
    return f"regexp_replace({text}, {pattern}, concat('\\1', {MARK_1}, '\\2', {MARK_2}, '\\3'), 'g')"


SHORT = f"trim(review, {WS})"


def snippets(columns: str, limit: int) -> str:
    short = f"CASE WHEN length({SHORT}) <= {limit} THEN {SHORT} ELSE concat(rtrim(substr({SHORT}, 1, {limit - 3}), {WS}), '...') END"
    return f"""WITH {HITS}, {QUERY_TERMS}, short AS (
  SELECT query_id, rank, review_id, terms, summary, {short} AS body FROM hits JOIN terms USING (query_id)), shown AS (
  SELECT query_id, rank, review_id,
       replace(replace({escape(f"CASE WHEN len(terms) = 0 THEN body ELSE {_mark(_mark('body'))} END")},
               {MARK_1}, '<mark>'), {MARK_2}, '</mark>') AS snippet,
       {escape("coalesce(summary, '')")} AS summary_html
  FROM short)
SELECT {columns} FROM shown"""


def free_text() -> str:
    slot = f"(('0x' || substr(md5(word), 1, 8))::BIGINT % {SLOTS})"
    def side(name: str, key: str, source: str) -> str:
        return f"""{name}_tf AS (
  SELECT {key}, {slot} AS slot, count(*) AS tf
  FROM (SELECT {key}, unnest({words('text')}) AS word FROM {source}) GROUP BY ALL)"""
    def unit(name: str, key: str) -> str:
        return f"""{name}_w AS (
  SELECT {key}, slot, tf * idf AS w FROM {name}_tf JOIN weights USING (slot)), {name}_n AS (
  SELECT {key}, sqrt(sum(w * w)) AS n FROM {name}_w GROUP BY {key}), {name}_u AS (
  SELECT {key}, slot, w / n AS u FROM {name}_w JOIN {name}_n USING ({key}) WHERE n > 0)"""
    return f"""WITH {CORPUS}, asked AS (SELECT item_id AS query_id, text FROM benchmark), {side('d', 'review_id', 'corpus')}, weights AS (
  SELECT slot, ln(((SELECT count(*) FROM corpus) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM d_tf GROUP BY slot),
{side('q', 'query_id', 'asked')}, {unit('d', 'review_id')}, {unit('q', 'query_id')}, sums AS (
  SELECT query_id, review_id, sum(d_u.u * q_u.u) AS s FROM d_u JOIN q_u USING (slot) GROUP BY ALL), scored AS (
  SELECT a.query_id, c.review_id, round(coalesce(s, 0), 9) AS score
  FROM asked a CROSS JOIN corpus c LEFT JOIN sums s ON s.query_id = a.query_id AND s.review_id = c.review_id)
SELECT * FROM (SELECT query_id, review_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id)::INTEGER AS rank FROM scored) WHERE rank <= {K}"""


def naive_bayes(tail: str) -> str:
    ratio = "ln((positive + a) / (n1 + a * v)) - ln((negative + a) / (n0 + a * v))"
    smoothing = ", ".join(f"({a}::DOUBLE)" for a in SMOOTHING)
    return f"""WITH labelled AS (SELECT doc_id, text, quality AS label, md5(concat('42:', text)) AS h
  FROM documents JOIN labels USING (doc_id)), parts AS (
  SELECT *, {SPLIT} AS split FROM labelled), train AS (SELECT * FROM parts WHERE split = 'train'), words AS (
  SELECT word, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label = 1) AS positive
  FROM (SELECT label, unnest({words('text')}) AS word FROM train) GROUP BY word), sums AS (
  SELECT sum(negative)::DOUBLE AS n0, sum(positive)::DOUBLE AS n1, count(*)::DOUBLE AS v FROM words), prior AS (
  SELECT ln(sum(label)::DOUBLE / (count(*) - sum(label))::DOUBLE) AS p FROM train), smoothings(a) AS (VALUES {smoothing}), evidence AS (
  SELECT a, word, {ratio} AS e FROM words, sums, smoothings), tf AS (
  SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS word FROM documents) GROUP BY ALL), added AS (
  SELECT doc_id, a, sum(tf * e) AS m FROM tf JOIN evidence USING (word) GROUP BY ALL), margins AS (
  SELECT d.doc_id, d.text, s.a, round(coalesce(m, 0.0) + p, 6) AS margin
  FROM documents d CROSS JOIN smoothings s CROSS JOIN prior LEFT JOIN added USING (doc_id, a)), tried AS (
  SELECT a, split, label, (margin > 0)::INTEGER AS prediction FROM parts JOIN margins USING (doc_id) WHERE split <> 'train'), measured AS (
  SELECT a, split, count(*) AS n_rows, round(avg((prediction = label)::INTEGER), 9) AS accuracy,
  round(CASE WHEN sum(prediction) + sum(label) = 0 THEN 0.0
        ELSE 2.0::DOUBLE * sum(prediction * label) / (sum(prediction) + sum(label)) END, 9) AS f1,
  round(greatest(avg(label), 1.0::DOUBLE - avg(label)), 9) AS majority_rate FROM tried GROUP BY a, split), chosen AS (
  SELECT coalesce((SELECT a FROM measured WHERE split = 'validation' ORDER BY f1 DESC, a LIMIT 1), {SMOOTHING[0]}) AS a), scored AS (
  SELECT doc_id AS review_id, CASE WHEN margin > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label_name,
  round(1 / (1 + exp(-abs(margin))), 6) AS confidence FROM margins
  WHERE a = (SELECT a FROM chosen) AND text IS NOT NULL AND length(trim(text, {WS})) > 0)
{tail}"""


def by_epochs(tail: str) -> str:
    """All steps of the training by epochs, one after the other."""
    slot = f"(('0x' || substr(md5(word), 1, 8))::BIGINT % {RECIPE.dims})::INTEGER"
    labelled = f"""labelled AS (SELECT doc_id, text, quality AS label, md5(concat('42:', text)) AS h,
  (('0x' || substr(md5(concat('42:', doc_id)), 1, 8))::BIGINT % {RECIPE.steps}) AS step
  FROM documents JOIN labels USING (doc_id)), parts AS (SELECT *, {SPLIT} AS split FROM labelled)"""
    counted = f"""tf AS MATERIALIZED (
  SELECT doc_id, {slot} AS slot, count(*) AS tf
  FROM (SELECT doc_id, unnest({words('text')}) AS word FROM documents) GROUP BY ALL), sizes AS (
  SELECT doc_id, sqrt(sum(tf)::DOUBLE) AS root FROM tf GROUP BY doc_id), shares AS (
  SELECT count(*)::DOUBLE / (2.0::DOUBLE * sum(label)) AS c1, count(*)::DOUBLE / (2.0::DOUBLE * (count(*) - sum(label))) AS c0
  FROM parts WHERE split = 'train'), totals AS (
  SELECT step, sum(label) * any_value(c1) + (count(*) - sum(label)) * any_value(c0) AS total
  FROM parts, shares WHERE split = 'train' GROUP BY step)"""

    def margin(weights: str) -> str:
        return f"""coalesce((SELECT sum(tf * w) FROM tf JOIN {weights} USING (slot) WHERE tf.doc_id = d.doc_id), 0.0)
  / coalesce(root, 1.0) + (SELECT w FROM {weights} WHERE slot = -1)"""

    levels = [f"w0 AS (SELECT range::INTEGER AS slot, 0.0::DOUBLE AS w FROM range(-1, {RECIPE.dims}))"]
    for i in range(RECIPE.epochs * RECIPE.steps):
        rate = rate_at(RECIPE, i)
        levels.append(f"""e{i} AS MATERIALIZED (
  SELECT doc_id, coalesce(root, 1.0) AS root,
  (1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin(f'w{i}')}))) - label) * CASE label WHEN 1 THEN c1 ELSE c0 END AS e
  FROM parts d LEFT JOIN sizes USING (doc_id) CROSS JOIN shares WHERE split = 'train' AND step = {i % RECIPE.steps}), g{i} AS (
  SELECT slot, sum(floor(e / root * {SCALE} + 0.5::DOUBLE)::BIGINT * tf) AS g FROM e{i} JOIN tf USING (doc_id) GROUP BY slot UNION ALL
  SELECT -1, sum(floor(e * {SCALE} + 0.5::DOUBLE)::BIGINT) FROM e{i}), w{i + 1} AS MATERIALIZED (
  SELECT slot, w * CASE slot WHEN -1 THEN 1.0::DOUBLE ELSE {1.0 - rate * RECIPE.decay!r}::DOUBLE END
    - {rate!r}::DOUBLE * (coalesce(g, 0)::DOUBLE / {SCALE} / total) AS w
  FROM w{i} LEFT JOIN g{i} USING (slot) CROSS JOIN (SELECT total FROM totals WHERE step = {i % RECIPE.steps}))""")
    tried = " UNION ALL ".join(
        f"SELECT {n} AS epoch, label, (({margin(f'w{(n + 1) * RECIPE.steps}')}) > 0)::INTEGER AS prediction "
        "FROM parts d LEFT JOIN sizes USING (doc_id) WHERE split = 'validation'"
        for n in range(RECIPE.epochs)
    )
    every = " UNION ALL ".join(f"SELECT {n} AS epoch, slot, w FROM w{(n + 1) * RECIPE.steps}" for n in range(RECIPE.epochs))
    return f"""WITH {labelled}, {counted}, {', '.join(levels)}, tried AS ({tried}), measured AS (
  SELECT epoch, count(*) AS n_rows, round(avg((prediction = label)::INTEGER), 9) AS accuracy,
  round(CASE WHEN sum(prediction) + sum(label) = 0 THEN 0.0
        ELSE 2.0::DOUBLE * sum(prediction * label) / (sum(prediction) + sum(label)) END, 9) AS f1,
  round(greatest(avg(label), 1.0::DOUBLE - avg(label)), 9) AS majority_rate FROM tried GROUP BY epoch), best AS (
  SELECT epoch FROM measured ORDER BY f1 DESC, epoch LIMIT 1), chosen AS MATERIALIZED (
  SELECT slot, w FROM ({every}) JOIN best USING (epoch)), margins AS (
  SELECT doc_id, text, round({margin('chosen')}, 6) AS margin FROM documents d LEFT JOIN sizes USING (doc_id))
{tail}"""


def registered_sql() -> dict[str, str]:
    cells = f"""WITH {INDEX} SELECT review_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS dim,
  round(unnest(embedding)::DOUBLE, 6) AS value FROM idx"""
    scores = naive_bayes("""SELECT review_id, label_name, confidence,
  CASE label_name WHEN 'POSITIVE' THEN 'Positive Review' ELSE 'Negative Review' END AS display,
  printf('%.4f', confidence) AS confidence_text, round_even(confidence * 100, 0)::INTEGER AS percent FROM scored""")
    counted = naive_bayes("""SELECT label_name, count(*) AS count FROM scored
GROUP BY 1 ORDER BY count DESC, label_name""")
    top = f"""WITH {MEAN}, best AS (
  SELECT review_id, score, row_number() OVER (ORDER BY score DESC, review_id)::INTEGER AS rank FROM scored)"""
    return {
        "source_profile": f"""WITH {RAW} SELECT count(*) AS n_rows, 7 AS n_columns,
  'Id, Text, Summary, Score, HelpfulnessNumerator, HelpfulnessDenominator, source' AS columns FROM raw""",
        "source_preview": f"WITH {RAW} SELECT * FROM raw ORDER BY Id LIMIT 5",
        "clean_reviews": f"WITH {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean",
        "label_distribution": f"WITH {CLEAN} SELECT label, count(*) AS count FROM clean GROUP BY label ORDER BY count DESC, label",
        "incremental_labels": f"WITH {CLEAN} SELECT label, count(*) AS count FROM clean GROUP BY label ORDER BY count DESC, label",
        "sample_exact_n": f"""WITH {CLEAN} SELECT review_id, label, text FROM clean
  ORDER BY md5(concat('42:', review_id)) LIMIT {SAMPLE_ROWS}""",
        "negative_reviews": f"WITH {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean WHERE label = 0",
        "search_corpus": f"WITH {CORPUS} SELECT * FROM corpus",
        "cluster_input": f"WITH {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean WHERE label = 0",
        "cluster_input_sample": f"""WITH {CLEAN} SELECT {CLEAN_COLUMNS} FROM clean WHERE label = 0
  ORDER BY md5(concat('42:', review_id)) LIMIT {CLUSTER_ROWS}""",
        "index_build": cells,
        "index_bucketed": cells,
        "index_missing": f"""WITH {CORPUS} SELECT review_id FROM corpus
  WHERE review_id NOT IN (SELECT vec_id FROM embeddings)""",
        "index_shape": f"""WITH {INDEX} SELECT count(*) AS n_rows, min(len(embedding))::INTEGER AS min_dim,
  max(len(embedding))::INTEGER AS max_dim FROM idx""",
        "search_topk": f"""{top} SELECT rank, score, review_id, summary, text AS review, Score::INTEGER AS rating
  FROM best JOIN (SELECT review_id, summary, text, Score AS rating_value FROM corpus) c USING (review_id)
  WHERE rank <= {K} ORDER BY rank""".replace("Score::INTEGER AS rating", "rating_value::INTEGER AS rating"),
        "search_relevance": f"{top} SELECT concat('Result ', rank) AS label, score FROM best WHERE rank <= {K} ORDER BY rank DESC",
        "search_pruned": f"{top} SELECT review_id, score FROM best WHERE rank <= 10",
        "search_batch_topk": BATCH,
        "search_batch_routed": BATCH,
        "search_compressed": BATCH.replace("FROM idx, embeddings e", "FROM idx, embeddings e WHERE e.vec_id % 100 = 0"),
        "search_text_tfidf": f"WITH {TFIDF} SELECT query_id, review_id, score, rank FROM ranked WHERE rank <= 10",
        "search_snippets": snippets("query_id, rank, review_id, snippet, summary_html", 500),
        "evidence_snippets": snippets("query_id, rank, review_id, snippet", 450),
        "search_free_text": free_text(),
        "sentiment_train_eval": naive_bayes("""SELECT split, n_rows, accuracy, f1, majority_rate
FROM measured WHERE a = (SELECT a FROM chosen)"""),
        "sentiment_score": scores,
        "sentiment_saved": scores,
        "sentiment_distribution": counted,
        "stream_distribution": counted,
        "epoch_metrics": by_epochs("SELECT *, epoch = (SELECT epoch FROM best) AS kept FROM measured"),
        "epoch_weights": by_epochs("SELECT slot, round(w, 6) AS weight FROM chosen WHERE w <> 0"),
        "sentiment_epochs": by_epochs(f"""SELECT doc_id AS review_id,
  CASE WHEN margin > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label_name, round(1 / (1 + exp(-abs(margin))), 6) AS confidence
  FROM margins WHERE text IS NOT NULL AND length(trim(text, {WS})) > 0"""),
        "run_stage_counts": f"""WITH {CORPUS}, kept AS (SELECT count(*) AS n FROM corpus), bad AS (
  SELECT count(*) AS n FROM clean WHERE label = 0)
SELECT 'clean' AS stage, count(*) AS n_rows FROM clean UNION ALL SELECT 'negative', n FROM bad
UNION ALL SELECT 'assigned', n FROM bad UNION ALL SELECT 'corpus', n FROM kept UNION ALL SELECT 'index', n FROM kept""",
        "reviews_csv_round_trip": f"""WITH {RAW} SELECT Id, Text, Summary, Score, HelpfulnessNumerator, HelpfulnessDenominator
  FROM raw""",
        "token_windows": f"""SELECT doc_id, w::INTEGER AS window, len(toks[w * 512 + 1:w * 512 + 512])::INTEGER AS n_kept,
  md5(array_to_string(toks[w * 512 + 1:w * 512 + 512], ' ')) AS kept_md5
FROM (SELECT doc_id, {words("coalesce(text, '')")} AS toks FROM documents),
  unnest(range(0, greatest(1, (len(toks) + 511) // 512))) u(w)""",
        "themes_assigned": f"""WITH cells AS (
  SELECT label, unnest(generate_series(1, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), means AS (
  SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL), lengths AS (
  SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY label), centres AS (
  SELECT label AS cluster, list(m / n ORDER BY pos) AS centre FROM means JOIN lengths USING (label) GROUP BY label), units AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE
    / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), best AS (
  SELECT vec_id, cluster, {dot('v', 'centre')} AS score,
         row_number() OVER (PARTITION BY vec_id ORDER BY {dot('v', 'centre')} DESC, cluster) AS n FROM units, centres), placed AS (
  SELECT vec_id, CASE WHEN 1 - score <= 0.8 THEN cluster END AS cluster FROM best WHERE n = 1), sizes AS (
  SELECT cluster, count(*) AS rows, min(vec_id) AS first FROM placed WHERE cluster IS NOT NULL GROUP BY cluster
  HAVING count(*) >= {TOPIC_ROWS}), numbers AS (
  SELECT cluster, row_number() OVER (ORDER BY rows DESC, first)::INTEGER - 1 AS topic FROM sizes)
SELECT vec_id AS review_id, coalesce(topic, -1)::INTEGER AS topic FROM placed LEFT JOIN numbers USING (cluster)""",
        "query_terms": f"""WITH {QUERY_TERMS} SELECT query_id, unnest(generate_series(0, len(terms) - 1))::INTEGER AS position,
  unnest(terms) AS term FROM terms""",
        "keyword_counts": f"""WITH {CORPUS}, tokens AS (
  SELECT review_id, unnest(toks) AS word, unnest(generate_series(0, len(toks) - 1))::INTEGER AS pos
  FROM (SELECT review_id, list_filter({words('text')},
        lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({STOP})) AS toks FROM corpus))
SELECT word, count(*) AS count, min(review_id) AS first_review,
       arg_min(pos, review_id * 1000000 + pos) AS first_pos FROM tokens GROUP BY word""",
        "keywords_topn": f"WITH {HIT_WORDS} SELECT query_id, rank, word, count FROM kw WHERE rank <= 8",
        "summary_with_evidence": f"""WITH {HIT_WORDS}, listed AS (
  SELECT query_id, string_agg(word, ', ' ORDER BY rank) AS listed FROM kw WHERE rank <= 6 GROUP BY query_id)
SELECT b.item_id AS query_id,
       replace(replace('{SUMMARY_SENTENCE.replace("'", "''")}', '{{keywords}}', coalesce(listed, '{NO_KEYWORDS}')),
               '{{query}}', b.text) AS sentence,
       h.rank, h.score, h.review_id, h.summary, h.rating
FROM benchmark b LEFT JOIN listed ON listed.query_id = b.item_id LEFT JOIN hits h ON h.query_id = b.item_id""",
        "topic_sizes": f"""WITH sizes AS (
  SELECT label, count(*) AS rows, min(vec_id) AS first FROM embeddings GROUP BY label HAVING count(*) >= {TOPIC_ROWS}), numbers AS (
  SELECT label, row_number() OVER (ORDER BY rows DESC, first)::INTEGER - 1 AS topic FROM sizes)
SELECT coalesce(topic, -1)::INTEGER AS topic, count(*) AS count
FROM embeddings LEFT JOIN numbers USING (label) GROUP BY 1""",
        "topic_names": f"WITH {TOPICS} SELECT topic, count, name FROM info",
        "topic_words": f"WITH {TOPICS} SELECT topic, word, weight, rank FROM top_words WHERE rank <= 10",
        "topic_table": f"""WITH {TOPICS} SELECT topic, count::INTEGER AS count, {escape('name')} AS name
  FROM info WHERE topic <> -1 ORDER BY topic LIMIT 10""",
        "topic_chart": f"""WITH {TOPICS}, shown AS (SELECT * FROM info WHERE topic <> -1 ORDER BY topic LIMIT 8)
SELECT topic, replace(regexp_replace(name, '^\\d+_', ''), '_', ' ') AS theme, count::INTEGER AS count,
       CASE WHEN (SELECT max(count) FROM shown) = 0 THEN 0.0::DOUBLE
            ELSE round(count::DOUBLE / (SELECT max(count) FROM shown) * 100, 1) END AS width_pct
FROM shown ORDER BY topic DESC""",
        "themes_density": DENSITY,
        "themes_hierarchy": HIERARCHY,
        "word_pmi": PMI,
        "split_80_10_10": f"""WITH {CLEAN} SELECT review_id, label, {SPLIT} AS split
  FROM (SELECT review_id, label, md5(concat('42:', review_id)) AS h FROM clean)""",
        "token_window": f"""SELECT doc_id, len(toks)::INTEGER AS n_tokens, least(len(toks), 512)::INTEGER AS n_kept,
  md5(array_to_string(toks[1:512], ' ')) AS kept_md5
FROM (SELECT doc_id, {words("coalesce(text, '')")} AS toks FROM documents)""",
        "metrics_binary": f"""WITH {RULE} SELECT {SPLIT} AS split, count(*) AS n_rows,
  round(avg((prediction = label)::INTEGER), 9) AS accuracy,
  round(CASE WHEN sum(prediction) + sum(label) = 0 THEN 0.0
        ELSE 2.0::DOUBLE * sum(prediction * label) / (sum(prediction) + sum(label)) END, 9) AS f1,
  round(greatest(avg(label), 1.0::DOUBLE - avg(label)), 9) AS majority_rate
FROM rule GROUP BY 1""",
        "prediction_display": f"""WITH {RULE} SELECT doc_id,
  CASE prediction WHEN 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label_name, prediction AS class_id,
  CASE prediction WHEN 1 THEN 'Positive Review' ELSE 'Negative Review' END AS display,
  printf('%.4f', greatest(s0, s1)) AS confidence_text,
  greatest(0, least(100, round_even(greatest(s0, s1) * 100, 0)))::INTEGER AS percent,
  trunc(n_chars / 7.0)::INTEGER AS whole, 0 AS not_a_number
FROM rule""",
        "dashboard_stats": f"""WITH {TOPICS} SELECT (SELECT count(*) FROM clean WHERE length(text) > 30) AS review_count,
  (SELECT count(*) FROM info WHERE topic <> -1) AS topic_count""",
    }
