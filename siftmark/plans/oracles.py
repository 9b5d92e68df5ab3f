"""Plain SQL for the same results, written against the stored tables."""

from __future__ import annotations

from siftmark import fixed_values as fixed


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DOMAINS = _list([*fixed.DOMAIN_KEYS, "unknown"])
WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f]+'), lambda w: w <> '')"
UNIFORM = "(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

RECORDS = f"""records AS (
  SELECT doc_id, source, lang, text, n_chars,
         {DOMAINS}[CAST(substr(source, 4) AS INTEGER) % 8 + 1] AS domain,
         CAST(n_chars % 551 AS DOUBLE) / 100 AS edu,
         doc_id % 14 AS topic,
         CAST(doc_id % 5 AS DOUBLE) AS epoch
  FROM documents)"""

# weights (i + 1) / sum in key order, collaboration a third each
LADDER_SCORE = """(
  CASE WHEN edu >= 0 AND edu < 5 THEN (floor(edu) + 1) / 15::DOUBLE ELSE 0 END / 3
  + list_position(['arxiv','book','c4','commoncrawl','github','stackexchange','wikipedia'], domain) / 28::DOUBLE / 3
  + (topic + 1) / 91::DOUBLE / 3) / (1 + 0.1::DOUBLE * epoch)"""

LOSSES = f"""losses AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'domain' ELSE 'quality' END AS family,
         CASE event_id % 3 WHEN 0 THEN 'topic_' || (user_id % 13)
              WHEN 1 THEN {_list(fixed.DOMAIN_KEYS)}[user_id % 7 + 1]
              ELSE {_list(fixed.QUALITY_KEYS)}[user_id % 5 + 1] END AS key,
         event_id * 2 + p AS seq, value / (100 * (p + 1)) AS loss
  FROM events, (VALUES (0), (1)) AS t(p)),
keys AS (
  SELECT 'quality' AS family, unnest({_list(fixed.QUALITY_KEYS)}) AS key, unnest(range(5)) AS ord
  UNION ALL SELECT 'domain', unnest({_list(fixed.DOMAIN_KEYS)}), unnest(range(5, 12))
  UNION ALL SELECT 'topic', unnest({_list(fixed.TOPIC_KEYS)}), unnest(range(12, 25)))"""

AGED = """aged AS (
  SELECT family, key, loss, seq,
         row_number() OVER (PARTITION BY family, key ORDER BY seq DESC) - 1 AS j,
         count(*) OVER (PARTITION BY family, key) AS n
  FROM losses)"""


def _fold(name: str, start: str, join: str = "") -> str:
    return f"""{name} AS (
  SELECT a.family, a.key, any_value(k.ord) AS ord, max(a.n) AS n, max_by(a.loss, a.seq) AS last_loss,
         pow(0.9::DOUBLE, max(a.n)) * {start} + sum(0.1::DOUBLE * pow(0.9::DOUBLE, j) * exp(a.loss * 0.5::DOUBLE)) AS weight
  FROM aged a JOIN keys k ON a.family = k.family AND a.key = k.key {join}
  GROUP BY a.family, a.key)"""


def _share(name: str, folded: str) -> str:
    return f"""{name} AS (
  SELECT family, key, ord, n, last_loss, weight / sum(weight) OVER (PARTITION BY family) AS weight,
         weight / sum(weight) OVER (PARTITION BY family) * (exp(last_loss * 0.6::DOUBLE) / 100 - 1) / n AS s
  FROM {folded})"""


def _collaborate(name: str, shares: str, before: str) -> str:
    return f"""{name}_moved AS (
  SELECT ord AS agent, {before} + sign(s - m) * abs(s - m) AS c
  FROM (SELECT ord, s, avg(s) OVER () AS m FROM {shares}) WHERE ord < 3),
{name} AS (SELECT agent, c / sum(c) OVER () AS weight FROM {name}_moved)"""


FOLDED = f"WITH {LOSSES}, {AGED}, {_fold('folded', '10')}"
SHARED = f"{FOLDED}, {_share('shares', 'folded')}"
COLLAB = f"{SHARED}, {_collaborate('collab', 'shares', '1 / 3::DOUBLE')}"

ITERATION = f"""{COLLAB}, {RECORDS}, scored AS (
  SELECT r.doc_id, r.source, r.lang, r.text,
         ((SELECT weight FROM collab WHERE agent = 0) * coalesce(q.weight, 0)
          + (SELECT weight FROM collab WHERE agent = 1) * d.weight
          + (SELECT weight FROM collab WHERE agent = 2) * t.weight) * (1 / (1 + 0.1::DOUBLE * epoch)) AS score
  FROM records r
  JOIN shares d ON d.family = 'domain' AND d.key = r.domain
  JOIN shares t ON t.family = 'topic' AND t.key = 'topic_' || r.topic
  LEFT JOIN shares q ON q.family = 'quality'
       AND r.edu >= CAST(split_part(q.key, '_', 2) AS DOUBLE) AND r.edu < CAST(split_part(q.key, '_', 3) AS DOUBLE)),
cut AS (
  SELECT min(score) AS threshold FROM (
    SELECT score, row_number() OVER (ORDER BY score DESC) AS place FROM scored)
  WHERE place <= (SELECT count(*) // 10 FROM documents))"""

PLACED = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS line_no FROM documents)"""

MEMBERS = """members AS (
  SELECT CAST(substr(source, 4) AS INTEGER) AS cluster, CASE WHEN doc_id % 17 <> 0 THEN n_chars::DOUBLE END AS rank,
         CASE WHEN doc_id % 19 <> 0 THEN text END AS content, doc_id FROM documents),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank NULLS LAST, doc_id) - 1 AS i,
         count(*) OVER (PARTITION BY cluster) AS n FROM members)"""

PREDICTIONS = """scores AS (
  SELECT vec_id, label, unnest(range(64)) AS class, unnest(embedding)::DOUBLE AS logit FROM embeddings),
preds AS (
  SELECT vec_id, any_value(label) AS label, arg_max(class, (logit, -class)) AS pred FROM scores GROUP BY vec_id),
cells AS (SELECT label, pred, count(*) AS n FROM preds GROUP BY ALL)"""

REPORT = f"""WITH {PREDICTIONS},
classes AS (
  SELECT c AS class, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
         coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1, support
  FROM (SELECT c, CAST(coalesce(sum(n) FILTER (WHERE label = c AND pred = c), 0) AS DOUBLE) AS hits,
               CAST(coalesce(sum(n) FILTER (WHERE pred = c), 0) AS DOUBLE) AS predicted,
               CAST(coalesce(sum(n) FILTER (WHERE label = c), 0) AS DOUBLE) AS support
        FROM cells, (SELECT label AS c FROM cells UNION SELECT pred FROM cells) GROUP BY c)),
accuracy AS (SELECT CAST(sum(n) FILTER (WHERE label = pred) AS DOUBLE) / sum(n) AS a FROM cells),
report AS (
  SELECT row_number() OVER (ORDER BY support DESC, class) AS place, CAST(class AS VARCHAR) AS name, precision, recall, f1, support FROM classes
  UNION ALL SELECT (SELECT count(*) FROM classes) + 1, 'accuracy', a, a, a, a FROM accuracy
  UNION ALL SELECT count(*) + 2, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes
  UNION ALL SELECT count(*) + 3, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM classes)"""

GRADIENTS = """gradients AS (
  SELECT vec_id, label, 0 AS ckpt, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id, label, 1, CAST(embedding[33:64] AS DOUBLE[]) FROM embeddings)"""

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

TOKENS = f"tokens AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"

PACKED = f"""WITH {TOKENS},
placed AS (
  SELECT t, row_number() OVER (ORDER BY doc_id, pos) - 1 AS off
  FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM tokens)),
filled AS (
  SELECT t, off FROM placed UNION ALL
  SELECT '<pad>', off FROM range((SELECT count(*) FROM placed), (SELECT greatest(1, ceil(count(*) / 512.0))::BIGINT * 512 FROM placed)) AS r(off)),
blocks AS (
  SELECT off // 512 AS chunk_id, (off % 512) // 64 AS block_id, string_agg(t, ' ' ORDER BY off) AS tokens
  FROM filled GROUP BY ALL)"""

TULU = "'<|user|>' || chr(10) || {body} || chr(10) || '<|assistant|>' || chr(10) || 'The answer is:'"
NL = " || chr(10) || "
PASSAGE = _text(fixed.PASSAGE_INSTRUCTION) + " || 'Passage: ' || {context} || chr(10) || 'Question: ' || {question} || chr(10)"


def _options(texts, sep="': '", before="", after="chr(10)") -> str:
    parts = []
    for i, text in enumerate(texts):
        lead = f"{before} || " if before else ""
        tail = f" || {after}" if after else ""
        parts.append(f"{lead}'{chr(65 + i)}' || {sep} || {text}{tail}")
    return " || ".join(parts)


def _template(table: str, ident: str, body: str, completion: str, extra: str = "") -> str:
    return f"""{extra}SELECT {ident}, {TULU.format(body=body)} AS prompt, {completion} AS completion FROM {table}"""


DOC_QUESTION = "'Which source has document ' || doc_id || '?'"
ITEMS = f"WITH items AS (SELECT item_id, text, {WORDS.format('text')} AS w FROM benchmark) "


def _w(i: int) -> str:
    return f"coalesce(w[{i}], '-')"


def _adopted(lang_index: int) -> str:
    return f"{_list([t[lang_index] for t in fixed.LANGUAGE_TEMPLATES.values()])}[doc_id % 9 + 1]"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # ---------------------------------------------------------------- scoring
    sql["score_documents"] = f"""WITH {RECORDS}
SELECT doc_id, domain, round({LADDER_SCORE}, 6) AS score FROM records WHERE domain <> 'unknown' AND topic < 13"""
    sql["score_epoch_decay"] = f"""WITH {RECORDS}
SELECT doc_id, epoch, round(1 / (1 + 0.1::DOUBLE * epoch), 6) AS decay FROM records"""
    flawed = f"""WITH {RECORDS}, flawed AS (
  SELECT * REPLACE (CASE WHEN doc_id % 14 = 10 THEN 5.0::DOUBLE ELSE edu END AS edu),
    CASE WHEN doc_id % 14 IN (1, 2, 6, 7, 12, 13) THEN 'bad_quality'
         WHEN doc_id % 14 = 3 OR domain = 'unknown' THEN 'unknown_domain'
         WHEN doc_id % 14 = 4 OR topic = 13 THEN 'unknown_topic'
         WHEN doc_id % 14 IN (8, 11) THEN 'bad_epoch'
         WHEN doc_id % 14 = 9 THEN 'zero_divisor' ELSE 'kept' END AS reason
  FROM records)"""
    sql["score_drop_rules"] = f"""{flawed}
SELECT doc_id, reason, CASE WHEN reason = 'kept' THEN round({LADDER_SCORE}, 6) END AS score FROM flawed"""
    sql["file_scores"] = f"""{flawed}, {PLACED}
SELECT p.source AS subfolder, p.lang AS file, p.line_no, round({LADDER_SCORE}, 6) AS score
FROM flawed JOIN placed p USING (doc_id) WHERE reason = 'kept'"""
    sql["quality_bucket_lookup"] = f"""WITH {RECORDS}
SELECT doc_id, edu, CASE WHEN edu < 5 THEN 'quality_' || floor(edu)::INT || '_' || (floor(edu)::INT + 1) END AS bucket,
       round(CASE WHEN edu < 5 THEN (floor(edu) + 1) / 15::DOUBLE ELSE 0 END, 6) AS quality FROM records"""

    # ---------------------------------------------------------------- weights
    sql["influence_flatten"] = f"""WITH {LOSSES}
SELECT family, key, row_number() OVER (PARTITION BY family, key ORDER BY seq) - 1 AS position, round(loss, 6) AS loss FROM losses"""
    sql["influence_stats"] = f"""WITH {LOSSES}
SELECT family, key, count(*) AS n, round(avg(loss), 10) AS mean_loss, round(stddev_pop(loss), 10) AS std_loss FROM losses GROUP BY ALL"""
    sql["ewma_weights"] = f"{FOLDED} SELECT family, key, n, round(weight, 6) AS weight FROM folded"
    sql["normalized_weights"] = f"{SHARED} SELECT family, key, round(weight, 6) AS weight FROM shares"
    sql["s_values"] = f"{SHARED} SELECT family, key, round(s * 1000, 6) + 0 AS s_thousandths FROM shares"
    sql["collaborative_weights"] = f"{COLLAB} SELECT CAST(agent AS INTEGER) AS agent, round(weight, 6) AS weight FROM collab"
    sql["second_iteration"] = f"""{COLLAB},
{_fold('folded2', 'any_value(b.weight)', 'JOIN shares b ON b.family = a.family AND b.key = a.key')},
{_share('shares2', 'folded2')},
{_collaborate('collab2', 'shares2', '(SELECT weight FROM collab WHERE agent = ord)')}
SELECT family, key, round(weight, 6) AS weight FROM shares2
UNION ALL SELECT 'collaboration', CAST(agent AS VARCHAR), round(weight, 6) FROM collab2"""

    # -------------------------------------------------------------- selection
    sql["full_iteration"] = f"""{ITERATION}
SELECT doc_id, round(score, 6) AS score, CAST(score >= (SELECT threshold FROM cut) AS INTEGER) AS selection FROM scored"""
    sql["topn_threshold"] = f"""{ITERATION}
SELECT round((SELECT threshold FROM cut), 6) AS threshold, count(*) AS selected FROM scored WHERE score >= (SELECT threshold FROM cut)"""
    sql["selection_flag"] = """SELECT o_orderkey, CAST(o_totalprice >= (SELECT min(p) FROM (
  SELECT o_totalprice AS p FROM orders ORDER BY p DESC LIMIT (SELECT count(*) // 20 FROM orders))) AS INTEGER) AS selection FROM orders"""
    sql["topn_zero"] = "SELECT o_orderkey, 0 AS selection FROM orders"
    sql["file_influences"] = sql["ewma_weights"]
    sql["file_weights"] = f"""{COLLAB} SELECT family, key, round(weight, 6) AS weight FROM shares
UNION ALL SELECT 'collaboration', CAST(agent AS VARCHAR), round(weight, 6) FROM collab"""
    sql["round_over_files"] = f"""{ITERATION} SELECT text AS content FROM scored WHERE score >= (SELECT threshold FROM cut)"""
    sql["round_resumed"] = f"""{ITERATION}
SELECT text AS content, round(score, 6) AS score, CAST(score >= (SELECT threshold FROM cut) AS INTEGER) AS selection FROM scored"""
    sql["file_flags"] = f"""WITH {PLACED}, marked AS (
  SELECT *, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 101 ELSE 0 END AS score FROM placed)
SELECT source AS subfolder, lang AS file, line_no, CAST(score >= (
  SELECT min(score) FROM (SELECT score FROM marked ORDER BY score DESC LIMIT 50)) AS INTEGER) AS selection FROM marked"""
    sql["file_selected_lines"] = f"""WITH {PLACED}
SELECT source AS subfolder, lang AS file, line_no, text AS content FROM placed WHERE doc_id % 6 < 3"""
    sql["select_lines"] = f"""{ITERATION}, {PLACED}
SELECT p.source AS subfolder, p.lang AS file, p.line_no, p.text AS line
FROM placed p JOIN scored s ON s.doc_id = p.doc_id WHERE s.score >= (SELECT threshold FROM cut)"""
    sql["top_percent"] = f"""{ITERATION}, best AS (
  SELECT score FROM scored ORDER BY score DESC LIMIT (SELECT count(*) * 5 // 100 FROM scored))
SELECT doc_id, round(score, 6) AS score FROM scored WHERE score >= (SELECT min(score) FROM best)"""

    # --------------------------------------------------------------- clusters
    members = MEMBERS
    sql["cluster_sample_10"] = f"""WITH {members}
SELECT cluster, rank, content, doc_id FROM ordered WHERE i % CAST(ceil(n / 10.0) AS BIGINT) = 0 AND content IS NOT NULL"""
    sql["file_clusters"] = f"""WITH {members}
SELECT cluster, rank, content FROM ordered WHERE i % CAST(ceil(n / 10.0) AS BIGINT) = 0 AND content IS NOT NULL"""
    sql["labelled_examples"] = f"""WITH answered AS (
  SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS cluster,
         CASE WHEN doc_id % 29 = 0 THEN 'Gardening' ELSE {_list(fixed.TOPIC_NAMES)}[doc_id % 13 + 1] END AS topic
  FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 11 <> 0)
SELECT doc_id, cluster, topic, CAST(dense_rank() OVER (ORDER BY topic) - 1 AS INTEGER) AS label, topic <> 'Gardening' AS known FROM answered"""
    by_size = """spaced AS (
  SELECT *, greatest(floor(n / k::DOUBLE), 1)::BIGINT AS step FROM (SELECT *, greatest(ceil(n / {per}.0), 1)::BIGINT AS k FROM ordered))"""
    sql["cluster_sample_by_size"] = f"""WITH {members}, {by_size.format(per=20)}
SELECT cluster, rank, content, doc_id FROM spaced WHERE i % step = 0 AND i // step < k AND content IS NOT NULL"""
    sql["cluster_sample_by_size_events"] = f"""WITH ordered AS (
  SELECT event_type AS cluster, floor(value) AS rank, props AS content, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY floor(value), event_id) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS n FROM events), {by_size.format(per=3000)}
SELECT cluster, rank, content, event_id FROM spaced WHERE i % step = 0 AND i // step < k"""
    sql["batch_requests"] = f"""SELECT doc_id, 'task-cluster-' || CAST(substr(source, 4) AS INTEGER) || '-rank-' || n_chars AS custom_id,
  'POST' AS method, '{fixed.ANNOTATOR_URL}' AS url, '{fixed.ANNOTATOR_MODEL}' AS model, '0.1' AS temperature,
  'json_object' AS format, 'system' AS first_role, {_text(fixed.ANNOTATOR_PROMPT)} AS prompt, 'user' AS second_role, text AS content FROM documents"""
    sql["parse_responses"] = f"""SELECT CASE WHEN doc_id % 7 <> 0 THEN CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR) END AS cluster,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS VARCHAR) END AS rank,
  CASE WHEN doc_id % 11 <> 0 THEN lang END AS topic,
  CASE WHEN doc_id % 11 <> 0 THEN {_list(fixed.TOPIC_NAMES)}[doc_id % 13 + 1] END AS selected_topic,
  CASE WHEN doc_id % 11 <> 0 THEN text END AS explanation FROM documents"""
    sql["cluster_windows"] = """SELECT CAST(doc_id // 100 * 100 AS BIGINT) AS window_start, count(*) AS rows FROM documents GROUP BY ALL"""

    # ---------------------------------------------------------------- metrics
    sql["label_map"] = f"""SELECT topic, CAST(row_number() OVER (ORDER BY topic) - 1 AS INTEGER) AS label
FROM (SELECT DISTINCT {_list(fixed.TOPIC_NAMES)}[doc_id % 13 + 1] AS topic FROM documents)"""
    sql["argmax_pred"] = f"WITH {PREDICTIONS} SELECT vec_id, label, CAST(pred AS INTEGER) AS pred FROM preds"
    sql["confusion_matrix"] = f"WITH {PREDICTIONS} SELECT label, CAST(pred AS INTEGER) AS pred, n FROM cells"
    sql["class_report"] = f"""{REPORT} SELECT CAST(place AS INTEGER) AS place, name, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(support, 6) AS support FROM report"""
    sql["macro_metrics"] = f"""{REPORT} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
  round(avg(f1), 6) AS f1, round((SELECT a FROM accuracy), 6) AS accuracy FROM classes"""
    sql["precision_threshold_counts"] = f"""{REPORT} SELECT threshold, CAST(count(*) FILTER (WHERE precision > threshold) AS BIGINT) AS rows
FROM report, (SELECT unnest([0.8, 0.6, 0.4, 0.2, 0.0])::DOUBLE AS threshold) GROUP BY threshold"""
    sql["topk_accuracy"] = f"""WITH {PREDICTIONS}, ranked AS (
  SELECT label, class, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class DESC) AS place FROM scores)
SELECT CAST(k AS INTEGER) AS k, round(count(*) FILTER (WHERE place <= k) / count(*)::DOUBLE, 6) AS accuracy
FROM ranked, range(1, 6) AS t(k) WHERE class = label GROUP BY k"""
    sql["class_weights"] = """SELECT label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)::DOUBLE), 6) AS weight
FROM embeddings GROUP BY label"""
    sql["softmax_threshold"] = f"""WITH {PREDICTIONS}, soft AS (
  SELECT vec_id, class, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM scores)
SELECT vec_id, round(p, 6) AS probability, p > 0.1 AS above FROM soft WHERE class = 1"""
    sql["cross_entropy"] = f"""WITH {PREDICTIONS}, spread AS (
  SELECT vec_id, ln(sum(exp(logit))) AS z FROM scores GROUP BY vec_id)
SELECT s.vec_id, CASE WHEN label <> 9 THEN round(z - logit, 6) END AS loss FROM scores s JOIN spread USING (vec_id) WHERE class = label"""
    sql["cross_entropy_mean"] = f"""WITH {PREDICTIONS}, spread AS (
  SELECT vec_id, ln(sum(exp(logit))) AS z FROM scores GROUP BY vec_id)
SELECT round(avg(z - logit), 6) AS loss FROM scores JOIN spread USING (vec_id) WHERE class = label AND label <> 9"""
    sql["sample_next"] = f"""WITH {PREDICTIONS}, top AS (
  SELECT vec_id, class, logit / 0.8::DOUBLE AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class) AS place FROM scores) WHERE place <= 3),
running AS (
  SELECT vec_id, class, sum(exp(l)) OVER (PARTITION BY vec_id ORDER BY class) / sum(exp(l)) OVER (PARTITION BY vec_id) AS upto FROM top)
SELECT vec_id, CAST(min(class) AS INTEGER) AS next FROM running
WHERE upto > {UNIFORM.format(seed=5, key='vec_id')} GROUP BY vec_id"""
    batches = f"""batches AS (
  SELECT doc_id, n_chars / 1000::DOUBLE AS loss, len({WORDS.format('text')}) AS num_tokens FROM documents)"""
    sql["token_weighted_loss"] = f"""WITH {batches}
SELECT CAST(sum(num_tokens) AS BIGINT) AS num_tokens, round(sum(loss * num_tokens) / sum(num_tokens), 6) AS loss FROM batches"""
    sql["mean_validation_loss"] = f"WITH {batches} SELECT round(avg(loss), 6) AS loss FROM batches"

    # --------------------------------------------------------------- matching
    sql["l2_normalize"] = """WITH v AS (
  SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE * (vec_id + 1) AS x FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12::DOUBLE), 6) + 0 AS value FROM v"""
    sql["sign_gradient"] = """SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(sign(x) AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""
    sql["adam_gradient"] = """WITH e AS (
  SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS g, unnest(list_reverse(embedding))::DOUBLE AS m,
         unnest(embedding[33:64] || embedding[1:32])::DOUBLE AS r FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos,
  round((0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g) / sqrt(0.999::DOUBLE * (r * r) + (1 - 0.999::DOUBLE) * g * g + 1e-8::DOUBLE), 6) + 0 AS value FROM e"""
    sql["match_influence"] = """WITH gradients AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT t.vec_id AS train_id, round(avg(list_dot_product(t.v, w.v)), 6) + 0 AS score
FROM gradients t, gradients w WHERE t.label <> 0 AND w.label = 0 GROUP BY t.vec_id"""
    sql["match_incomplete"] = f"""WITH {GRADIENTS}, pairs AS (
  SELECT t.vec_id AS train_id, w.vec_id // 6 AS sub, w.vec_id AS val_id, sum(list_dot_product(t.v, w.v) / 2) AS d
  FROM gradients t JOIN gradients w ON t.ckpt = w.ckpt WHERE w.vec_id < 54 GROUP BY ALL)
SELECT train_id, CASE WHEN train_id % 5 <> 0 THEN round(max(m), 6) + 0 END AS score
FROM (SELECT train_id, sub, avg(d) AS m FROM pairs GROUP BY ALL) GROUP BY train_id"""
    sql["match_multi_ckpt"] = f"""WITH {GRADIENTS}, pairs AS (
  SELECT t.vec_id AS train_id, w.vec_id // 2 AS sub, w.vec_id AS val_id,
         sum(CASE t.ckpt WHEN 0 THEN 2 / 5::DOUBLE ELSE 3 / 5::DOUBLE END * list_dot_product(t.v, w.v)) AS d
  FROM gradients t JOIN gradients w ON t.ckpt = w.ckpt WHERE t.vec_id >= 54 AND w.vec_id < 54 GROUP BY ALL)
SELECT train_id, round(max(m), 6) + 0 AS score FROM (SELECT train_id, sub, avg(d) AS m FROM pairs GROUP BY ALL) GROUP BY train_id"""
    def projected(width: int, seed: int) -> str:
        digit = f"strpos('0123456789abcdef', substr(md5('{seed}:' || i || ':' || (j // 128)), CAST(j % 128 // 4 + 1 AS BIGINT), 1)) - 1"
        return f"""signs AS (
  SELECT i, j, CAST((({digit}) >> (j % 4)) & 1 AS DOUBLE) * 2 - 1 AS s FROM range(64) AS a(i), range({width}) AS b(j)),
elements AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
projected AS (SELECT vec_id, any_value(label) AS label, j, sum(x * s) AS y FROM elements JOIN signs USING (i) GROUP BY vec_id, j)"""

    unit = "y / greatest(sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 1e-12::DOUBLE)"
    sql["random_projection"] = f"""WITH {projected(16, 0)}
SELECT vec_id, CAST(j AS INTEGER) AS pos, round(y, 6) + 0 AS value FROM projected"""
    sql["project_and_normalize"] = f"""WITH {projected(160, 3)}
SELECT vec_id, CAST(j AS INTEGER) AS pos, round({unit}, 6) + 0 AS value FROM projected"""
    sql["gradient_matching"] = f"""WITH {projected(32, 0)}, units AS (SELECT vec_id, label, j, {unit} AS u FROM projected),
centre AS (SELECT j, avg(u) AS c FROM units WHERE label = 0 GROUP BY j)
SELECT vec_id AS train_id, round(sum(u * c), 6) + 0 AS score FROM units JOIN centre USING (j) GROUP BY vec_id"""
    bucket = "('0x' || substr(md5(t), 1, 8))::BIGINT % 64"
    sql["unigram_influence"] = f"""WITH {TOKENS},
counted AS (SELECT doc_id, {bucket} AS b, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM tokens) GROUP BY ALL),
held AS (
  SELECT b, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS v
  FROM (SELECT {bucket} AS b FROM (SELECT unnest({WORDS.format('text')}) AS t FROM benchmark)) GROUP BY b),
gradient AS (
  SELECT d.doc_id, k.b, 1 / 64::DOUBLE - coalesce(c.n / sum(c.n) OVER (PARTITION BY d.doc_id), 0) AS g
  FROM documents d CROSS JOIN range(64) AS k(b) LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.b = k.b),
clipped AS (
  SELECT doc_id, b, g * least(1.0::DOUBLE, 1 / greatest(sqrt(sum(g * g) OVER (PARTITION BY doc_id)), 1e-12::DOUBLE)) AS g FROM gradient),
stepped AS (SELECT doc_id, b, -0.001::DOUBLE * g / (abs(g) + 1e-8::DOUBLE) AS l FROM clipped),
spread AS (SELECT doc_id, ln(sum(exp(l))) AS z FROM stepped GROUP BY doc_id)
SELECT doc_id, round(sum(v * (z - l)), 6) + 0 AS influence FROM stepped JOIN spread USING (doc_id) JOIN held USING (b) GROUP BY doc_id"""
    sql["provider_rows"] = f"""WITH {TOKENS},
counted AS (SELECT doc_id, {bucket} AS b, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM tokens) GROUP BY ALL)
SELECT d.doc_id, CAST(k.b AS INTEGER) AS token, round(coalesce(c.n / sum(c.n) OVER (PARTITION BY d.doc_id), 0), 6) + 0 AS share
FROM documents d CROSS JOIN range(64) AS k(b) LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.b = k.b"""
    uniform_held = "held AS (SELECT CAST(b AS BIGINT) AS b, 1 / 64::DOUBLE AS v FROM range(64) AS k(b))"
    before, rest = sql["unigram_influence"].split("held AS (", 1)
    sql["interrupted_provider"] = before + uniform_held + ",\n" + rest[rest.index("gradient AS ("):]
    sql["losses_written"] = sql["token_weighted_loss"]
    sql["predictions_written"] = f"""{REPORT}, predicted AS (SELECT CAST(pred AS VARCHAR) AS name, count(*) AS predicted FROM preds GROUP BY ALL)
SELECT CAST(place AS INTEGER) AS place, name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(support, 6) AS support, predicted FROM report LEFT JOIN predicted USING (name)"""
    sql["ckpt_renormalize"] = """SELECT label AS ckpt, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM embeddings GROUP BY label"""

    # ------------------------------------------------------------------ texts
    sql["qa_join"] = f"""WITH {PAIRS}
SELECT conv_id, turn, CASE WHEN regexp_matches(question, '[ \\n\\t]$') OR regexp_matches(answer, '^[ \\n\\t]')
  THEN question || answer ELSE question || ' ' || answer END || '</s>' AS text FROM pairs"""
    whole = """question || CASE WHEN regexp_matches(question, '[ \\n\\t]$') OR regexp_matches(answer, '^[ \\n\\t]') THEN '' ELSE ' ' END || answer || ' </s>'"""
    sql["qa_encode"] = f"""WITH {PAIRS}, cut AS (
  SELECT conv_id, turn, {WORDS.format(f"({whole})")}[1:1024] AS w, least(len({WORDS.format('question')}), 1024) AS p FROM pairs)
SELECT conv_id, turn, array_to_string(w, ' ') AS input_ids,
  array_to_string(list_transform(w, lambda x, i: CASE WHEN i <= p THEN '-100' ELSE x END), ' ') AS labels,
  CAST(len(w) AS INTEGER) AS attended FROM cut"""
    sql["pad_with_mask"] = f"""WITH {TOKENS}, chunks AS (
  SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, w[k * 192 + 1 : k * 192 + 256] AS w FROM tokens, unnest(range(0, (len(w) + 191) // 192)) AS t(k))
SELECT doc_id, chunk_no, array_to_string(list_transform(range(1, 257), lambda i: coalesce(w[i], '0')), ' ') AS input_ids,
  array_to_string(list_transform(range(1, 257), lambda i: coalesce(w[i], '-1')), ' ') AS labels,
  repeat('1', len(w)) || repeat('0', 256 - len(w)) AS attention_mask FROM chunks"""
    sql["last_token_state"] = """SELECT vec_id, round(x, 6) + 0 AS first, round(-x, 6) + 0 AS second
FROM (SELECT vec_id, embedding[vec_id % 64 + 1]::DOUBLE AS x FROM embeddings)"""
    sql["prompt_mask"] = f"""WITH {PAIRS}, cut AS (
  SELECT conv_id, turn, {WORDS.format("question || ' ' || answer")}[1:1024] AS w, least(len({WORDS.format('question')}), 1024) AS p FROM pairs)
SELECT conv_id, turn, array_to_string(w, ' ') AS input_ids,
  array_to_string(list_transform(w, lambda x, i: CASE WHEN i <= p THEN '-100' ELSE x END), ' ') AS labels,
  CAST(greatest(len(w) - p, 0) AS INTEGER) AS counted FROM cut"""
    sql["pad_truncate"] = f"""WITH {TOKENS}
SELECT doc_id, array_to_string(list_transform(range(1, 1025), lambda i: coalesce(w[i], '0')), ' ') AS input_ids FROM tokens"""
    sql["chunk_overlap"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * 384 AS INTEGER) AS start, array_to_string(w[k * 384 + 1 : k * 384 + 512], ' ') AS input_ids
FROM tokens, unnest(range(0, (len(w) + 383) // 384)) AS t(k)"""
    sql["chunk_all"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(sum(least(100, len(w) - k * 75)) AS BIGINT) AS held
FROM tokens, unnest(range(0, (len(w) + 74) // 75)) AS t(k) GROUP BY doc_id, len(w)"""
    sql["chunk_stopped"] = f"""WITH {TOKENS}
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(k * 384 AS INTEGER) AS start, array_to_string(w[k * 384 + 1 : k * 384 + 512], ' ') AS input_ids
FROM tokens, range(0, 3) AS t(k) WHERE k * 384 < len(w) AND (k = 0 OR (k - 1) * 384 + 512 < 1024)"""
    sql["chunk_whole"] = f"""WITH {TOKENS}
SELECT doc_id, array_to_string(w[k * 768 + 1 : k * 768 + 1024], ' ') AS input_ids, CAST(least(len(w) - k * 768, 1024) AS INTEGER) AS n
FROM tokens, unnest(range(0, (len(w) + 767) // 768)) AS t(k)"""
    sql["pack_blocks"] = f"{PACKED} SELECT chunk_id, CAST(block_id AS INTEGER) AS block_id, tokens FROM blocks"
    sql["block_permutation"] = f"""{PACKED}, windows AS (
  SELECT *, chunk_id // 2 AS window_id, count(*) OVER (PARTITION BY chunk_id // 2) AS n FROM blocks)
SELECT chunk_id, CAST(block_id AS INTEGER) AS block_id, CAST(window_id * 16 + row_number() OVER (PARTITION BY window_id
  ORDER BY {UNIFORM.format(seed=12345, key="chunk_id || ':' || block_id")}, chunk_id, block_id) - 1 AS BIGINT) AS read_order
FROM windows WHERE n = 16"""
    sql["block_permutation_wrap"] = f"""{PACKED}, size AS (SELECT max(chunk_id) + 1 AS chunks FROM blocks),
places AS (SELECT CAST(p AS BIGINT) AS place, CAST(p % chunks AS BIGINT) AS chunk_id FROM size, unnest(range(0, CAST((chunks + 3) // 4 * 4 AS BIGINT))) AS t(p))
SELECT chunk_id, CAST(block_id AS INTEGER) AS block_id, CAST(place // 4 * 32 + row_number() OVER (PARTITION BY place // 4
  ORDER BY {UNIFORM.format(seed=12345, key="place || ':' || block_id")}, place, block_id) - 1 AS BIGINT) AS read_order
FROM places JOIN blocks USING (chunk_id)"""
    place = "row_number() OVER (ORDER BY event_id)"
    sql["slice_counted"] = f"SELECT event_id, CAST({place} // 1250 AS BIGINT) AS slice FROM events"
    sql["slice_plain"] = f"SELECT event_id, CAST(({place} - 1) // 1250 AS BIGINT) AS slice FROM events"
    sql["shard_files"] = """SELECT page_id, CASE WHEN i < (n // 6) * 6 THEN i % 6 END AS shard
FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)"""

    # --------------------------------------------------------------- sampling
    u = UNIFORM.format(seed=7, key="doc_id")
    sql["random_sample"] = f"""SELECT doc_id, text FROM documents ORDER BY {u}, doc_id
LIMIT (SELECT CAST(floor(count(*) * 0.25) AS BIGINT) FROM documents)"""
    sql["validation_rows"] = f"SELECT doc_id, text FROM documents ORDER BY {UNIFORM.format(seed=11, key='doc_id')}, doc_id LIMIT 500"
    sql["train_valid_split"] = f"""SELECT doc_id, CASE WHEN {UNIFORM.format(seed=3, key='doc_id')} < 0.9 THEN 'train' ELSE 'valid' END AS part FROM documents"""
    sql["weighted_mixture"] = f"""WITH draws AS (
  SELECT d AS draw, {UNIFORM.format(seed=12345, key='d')} AS u FROM range((SELECT count(*) FROM documents)) AS r(d)),
picks AS (
  SELECT draw, CASE WHEN u < 0.4 THEN 'en' WHEN u < 0.7 THEN 'fr' WHEN u < 0.9 THEN 'de' ELSE 'es' END AS lang FROM draws),
turns AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw) AS turn FROM picks),
queues AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents),
matched AS (SELECT t.draw, t.lang, q.doc_id FROM turns t LEFT JOIN queues q ON q.lang = t.lang AND q.turn = t.turn)
SELECT draw, lang, doc_id FROM matched
WHERE draw < coalesce((SELECT min(draw) FROM matched WHERE doc_id IS NULL), (SELECT count(*) FROM documents))"""
    sql["cycle_epochs"] = "SELECT doc_id, CAST(e AS INTEGER) AS epoch FROM documents, range(3) AS t(e)"

    # --------------------------------------------------------------- formulas
    sql["wsd_lr"] = """SELECT event_id, round(1000000 * CASE WHEN s < 16000 THEN 0.001::DOUBLE * s / 16000::DOUBLE
  WHEN s < 400000 THEN 0.001::DOUBLE ELSE 0.001::DOUBLE * pow(0.5::DOUBLE, (s - 400000) / 400::DOUBLE) END, 6) AS lr_millionths
FROM (SELECT event_id, event_id * 41 AS s FROM events)"""
    sql["flops_estimate"] = """SELECT doc_id, round((3 * (2 * 1300000000::DOUBLE * n + 24 * 4::DOUBLE * 2048 * n * n) + 2 * 24 * 4::DOUBLE * 2048 * n * n) / 1e12, 6) AS teraflops
FROM (SELECT doc_id, n_chars::DOUBLE AS n FROM documents)"""
    sql["round_up"] = "SELECT doc_id, CAST((n_chars + 63) // 64 * 64 AS BIGINT) AS padded FROM documents"

    # -------------------------------------------------------------- templates
    doc_options = ["source", "lang", "(source || lang)", "'none'"]
    passage = PASSAGE.format(context="text", question=DOC_QUESTION)
    sql["template_boolq"] = _template("documents", "doc_id", passage, "CASE WHEN doc_id % 2 = 0 THEN ' True' ELSE ' False' END")
    sql["template_squad"] = _template("documents", "doc_id", passage, "' ' || source")
    sql["template_race"] = _template(
        "documents", "doc_id", f"{passage} || {_options(doc_options)}", "' ' || chr(CAST(65 + doc_id % 4 AS INTEGER))"
    )
    sql["template_social_iqa"] = _template(
        "documents", "doc_id", f"{passage} || {_options(doc_options[:3])}", "' ' || chr(CAST(65 + doc_id % 3 AS INTEGER))"
    )
    choices = _options([_w(1), _w(2), _w(3), _w(4)])
    for task in ("arc_easy", "arc_challenge", "commonsense_qa", "openbookqa"):
        sql[f"template_{task}"] = _template(
            "items", "item_id", f"text || chr(10) || {choices}", "chr(CAST(65 + item_id % 4 AS INTEGER))", ITEMS
        )
    sql["template_sciq"] = _template("items", "item_id", f"text || chr(10) || {choices}", "' ' || text", ITEMS)
    sql["template_winogrande"] = _template(
        "items", "item_id", f"text || chr(10) || 'Option:' || chr(10) || {_options([_w(1), _w(2)])}",
        "' ' || chr(CAST(65 + item_id % 2 AS INTEGER))", ITEMS,
    )
    sql["template_hellaswag"] = _template(
        "items", "item_id",
        f"{_text(fixed.SENTENCE_INSTRUCTION)} || 'Sentence:' || chr(10) || text || '____' || chr(10) || 'Choices:' || chr(10) || {choices}",
        "' ' || chr(CAST(65 + item_id % 4 AS INTEGER))", ITEMS,
    )
    sql["template_lambada"] = _template(
        "items", "item_id",
        f"{_text(fixed.LAST_WORD_INSTRUCTION)} || 'Sentence:' || chr(10) || array_to_string(w[1:len(w) - 1], ' ') || ' _____' || chr(10)",
        "' ' || w[len(w)]", ITEMS,
    )
    sql["template_jeopardy"] = _template(
        "items", "item_id",
        f"{_text(fixed.DESCRIPTION_INSTRUCTION)} || chr(10) || 'Description:' || chr(10) || text || chr(10)", "' ' || w[1]", ITEMS,
    )
    mmlu_options = _options([_w(1), _w(2), _w(3), _w(4)], sep="'. '", before="chr(10)", after="")
    sql["template_mmlu"] = _template(
        "items", "item_id",
        f"{_text(fixed.MMLU_INSTRUCTION)} || ' high school ' || (item_id % 5) || '.' || chr(10) || chr(10) || text || {mmlu_options} || chr(10) || 'Answer:'",
        "' ' || chr(CAST(65 + item_id % 4 AS INTEGER))", ITEMS,
    )
    tydi_body = (
        f"{_adopted(0)} || {_adopted(1)} || ' ' || text || chr(10) || {_adopted(2)} || ' ' || {DOC_QUESTION} || chr(10)"
    )
    sql["template_tydiqa"] = f"""SELECT doc_id, '<|user|>' || chr(10) || {tydi_body} || '<|assistant|>' || chr(10) || {_adopted(3)} AS prompt,
  ' ' || source AS completion FROM documents"""
    sql["template_bbh"] = f"""{ITEMS}, asked AS (
  SELECT item_id, text, CAST(k AS INTEGER) AS example_no,
         ['Q: ' || {_w(1)}, 'Q: ' || {_w(2)}, 'Q: ' || {_w(3)}] AS q, [' ' || {_w(4)}, ' ' || {_w(5)}, ' ' || {_w(6)}] AS a
  FROM items, range(3) AS t(k))
SELECT item_id, example_no, '<|user|>' || chr(10) || text || chr(10) || chr(10) || array_to_string(list_transform(list_filter([1, 2, 3],
    lambda i: i <> example_no + 1), lambda i: q[i] || chr(10) || 'A:' || a[i] || chr(10) || chr(10)), '')
  || q[example_no + 1] || chr(10) || '<|assistant|>' || chr(10) || 'A:' AS prompt, a[example_no + 1] AS completion FROM asked"""
    sql["bbh_styles"] = f"""{ITEMS}, asked AS (
  SELECT item_id, text, CAST(k AS INTEGER) AS example_no, ['Q: ' || {_w(1)}, 'Q: ' || {_w(2)}, 'Q: ' || {_w(3)}][k + 1] AS q,
         [' ' || {_w(4)}, ' ' || {_w(5)}, ' ' || {_w(6)}][k + 1] AS a FROM items, range(3) AS t(k))
SELECT item_id, example_no, 'inst' AS style, '<s> [INST] ' || text || ' ' || q || ' [/INST] A:' AS prompt, a AS completion FROM asked
UNION ALL SELECT item_id, example_no, 'raw', text || chr(10) || chr(10) || q || chr(10) || 'A:', a FROM asked"""
    sql["template_tydiqa_zh"] = f"""SELECT doc_id, '<|user|>' || chr(10) || {_text(fixed.CHINESE_TEMPLATE[0])} || {_text(fixed.CHINESE_TEMPLATE[1])} || ' ' || text || chr(10)
  || {_text(fixed.CHINESE_TEMPLATE[2])} || ' ' || {DOC_QUESTION} || chr(10) || '<|assistant|>' || chr(10) || {_text(fixed.CHINESE_TEMPLATE[3])} AS prompt,
  ' ' || source AS completion FROM documents"""
    squad = TULU.format(body=passage)
    sql["squad_rows"] = f"""WITH items AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS item_no FROM documents),
kept AS (SELECT * FROM items WHERE item_no < 501 ORDER BY {UNIFORM.format(seed=0, key='item_no')}, item_no LIMIT 500),
cut AS (
  SELECT doc_id, item_no, {WORDS.format(f"({squad} || ' ' || source)")}[1:1024] AS w, least(len({WORDS.format(f"({squad})")}), 1024) AS p FROM kept)
SELECT doc_id, CAST(item_no AS BIGINT) AS item_no, array_to_string(w, ' ') AS input_ids,
  array_to_string(list_transform(w, lambda x, i: CASE WHEN i <= p THEN '-' ELSE x END), ' ') AS labels FROM cut"""
    sql["file_bbh"] = "SELECT 'task_' || item_id AS task, text FROM benchmark"
    sql["file_tydiqa"] = f"""SELECT language, text AS context, 'item ' || item_id AS question, {WORDS.format('text')}[1] AS answer
FROM (SELECT *, {_list(fixed.LANGUAGE_TEMPLATES)}[item_id % 9 + 1] AS language FROM benchmark)
QUALIFY row_number() OVER (PARTITION BY language ORDER BY item_id) = 1"""
    sql["file_mmlu"] = f"""SELECT 'subject_' || item_id % 3 AS subject, CAST(row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1 AS INTEGER) AS row_no,
  text AS question, array_to_string({WORDS.format('text')}[1:4], '|') AS options, ['A', 'B', 'C', 'D'][item_id % 4 + 1] AS answer
FROM benchmark QUALIFY row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) <= 10"""
    lengths = PACKED.replace("SELECT t, row_number()", "SELECT CAST(length(t) AS VARCHAR) AS t, row_number()").replace("'<pad>'", "'0'")
    sql["file_packed"] = f"""{lengths} SELECT chunk_id, string_agg(tokens, ' ' ORDER BY block_id) AS tokens FROM blocks GROUP BY chunk_id"""
    inst = "'<s> [INST] ' || {body} || ' [/INST] The answer is:'"
    sql["template_chat_styles"] = f"""{ITEMS}, bodies AS (
  SELECT item_id, {_text(fixed.DESCRIPTION_INSTRUCTION)} || chr(10) || 'Description:' || chr(10) || text || chr(10) AS body FROM items)
SELECT item_id, 'inst' AS style, {inst.format(body='body')} AS prompt FROM bodies UNION ALL SELECT item_id, 'raw', body FROM bodies"""
    return sql
