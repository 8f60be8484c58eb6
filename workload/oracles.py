"""DuckDB SQL for the registered queries, built from named common table expressions."""

from __future__ import annotations

import re

from docqa.operators.answering import ERROR_PREFIX, PROMPT_TEMPLATE
from docqa.operators.chat import NO_MESSAGE

NL = "chr(10)"
B = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{B}+|{B}+\z', '', 'g')"


_SCRIPTS = [r"\p{Han}", r"\p{Hiragana}", r"\p{Katakana}ーｰ"]
_RUNS = "|".join([*(f"[{s}]+" for s in _SCRIPTS), r"[^\P{L}%s]+" % "".join(_SCRIPTS)])


def all_words(x: str) -> str:
    """Words of a text: pairs of letters inside runs of Han, Hiragana or Katakana, other runs of letters as they are."""
    unspaced = f"regexp_full_match(r, '[{''.join(_SCRIPTS)}]{{2,}}')"
    pairs = "list_transform(range(len(r) - 1), lambda i: substr(r, i + 1, 2))"
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '{_RUNS}'), lambda r: CASE WHEN {unspaced} THEN {pairs} ELSE [r] END))"


def words(x: str) -> str:
    return f"list_distinct({all_words(x)})"


def is_blank(x: str) -> str:
    return rf"regexp_full_match({x}, '{B}*')"


def without_noise(x: str) -> str:
    """A value without its last 13 bits, which the order of a sum decides by chance."""
    return f"({x} * 8193.0 - ({x} * 8193.0 - {x}))"


# name -> (needed names, body)
CTES: dict[str, tuple[list[str], str]] = {
    "sectioned": (
        [],
        f"""SELECT doc_id, source || '.pdf' AS file_name,
          CASE WHEN doc_id % 3 = 0 THEN '' ELSE '第' || doc_id || '条（' || source || '）' || {NL} END
          || replace(text, {NL}, {NL} || ' ' || {NL})
          || CASE WHEN doc_id % 5 = 0 THEN {NL} || ' ' || {NL} || '第99条 末尾' ELSE '' END AS text
        FROM documents""",
    ),
    "sections": (
        ["sectioned"],
        rf"""SELECT doc_id, file_name, unnest(s) AS section, unnest(range(len(s))) AS pos FROM (
          SELECT doc_id, file_name, string_split_regex({strip(f"regexp_replace(text, '\n+', {NL}, 'g')")}, '\n{B}*\n+') AS s
          FROM sectioned)""",
    ),
    "titled": (
        ["sections"],
        rf"""SELECT *, regexp_replace(regexp_extract(section, '\A(第{B}*\p{{Nd}}+{B}*条[^\n]*)', 1), '{B}+\z', '') AS title
        FROM sections""",
    ),
    "parts": (["titled"], f"SELECT *, {strip('substr(section, length(title) + 1)')} AS content FROM titled"),
    "chunks": (
        ["parts"],
        f"""SELECT *, doc_id || ':' || chunk_id AS chunk_key FROM (
          SELECT doc_id, file_name, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_id,
            CASE WHEN title <> '' THEN title || ':' || {NL} || content ELSE content END AS chunked_text
          FROM parts WHERE content <> '')""",
    ),
    "messages": (
        [],
        """SELECT conv_id, turn, role, text FROM conversations UNION ALL
        SELECT -1 - conv_id, turn, CASE WHEN role = 'user' THEN 'system' ELSE role END, text FROM conversations""",
    ),
    "opened": (
        [],
        """SELECT conv_id AS query_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question
        FROM conversations GROUP BY conv_id""",
    ),
    "opened_gaps": (
        ["messages"],
        """SELECT conv_id, max(turn) AS last_turn,
          coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question
        FROM messages GROUP BY conv_id""",
    ),
    "questions": (["opened"], "SELECT * FROM opened WHERE question <> ''"),
    "questions_gaps": (
        ["opened_gaps"],
        "SELECT conv_id AS query_id, question FROM opened_gaps WHERE question <> ''",
    ),
    "chunk_counts": (
        ["chunks"],
        f"""SELECT chunk_key, ('0x' || left(md5(word), 6))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS n
        FROM (SELECT chunk_key, unnest({all_words('chunked_text')}) AS word FROM chunks)
        GROUP BY ALL""",
    ),
    "chunk_norms": (
        ["chunk_counts"],
        "SELECT chunk_key, sqrt(sum(n * n)) AS norm, sum(n * n) AS squares FROM chunk_counts GROUP BY chunk_key",
    ),
}


def _text(x: str) -> str:
    """A string literal."""
    return f" || {NL} || ".join("'" + line.replace("'", "''") + "'" for line in x.split("\n"))


_BEFORE, _BETWEEN, _AFTER = re.split(r"\{context\}|\{input\}", PROMPT_TEMPLATE)
_PROMPT = f"{_text(_BEFORE)} || coalesce(c.context_text, '') || {_text(_BETWEEN)} || q.question || {_text(_AFTER)}"


def _search(name: str, source: str, chunks: str = "chunks", counts: str = "chunk_counts", norms: str = "chunk_norms") -> None:
    """Hits of the questions in ``source`` among ``chunks``, named ``name``."""
    CTES[f"{name}_counts"] = (
        [source],
        f"""SELECT query_id, ('0x' || left(md5(word), 6))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS n
        FROM (SELECT query_id, unnest({all_words('question')}) AS word FROM {source})
        GROUP BY ALL""",
    )
    CTES[f"{name}_norms"] = (
        [f"{name}_counts"],
        f"SELECT query_id, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY query_id",
    )
    CTES[f"{name}_dots"] = (
        [f"{name}_counts", counts],
        f"""SELECT q.query_id, c.chunk_key, sum(q.n * c.n) AS dot
        FROM {name}_counts q JOIN {counts} c ON q.bucket = c.bucket GROUP BY ALL""",
    )
    CTES[name] = (
        [source, chunks, f"{name}_dots", f"{name}_norms", norms],
        f"""SELECT query_id, chunk_key, score, rank FROM (
          SELECT query_id, chunk_key, score,
            row_number() OVER (PARTITION BY query_id ORDER BY {without_noise('value')} DESC, chunk_key) AS rank
          FROM (
            SELECT q.query_id, c.chunk_key, coalesce(round(d.dot / (qn.norm * cn.norm), 6), 0.0) AS score,
              coalesce(d.dot * d.dot / cn.squares, 0.0) AS value
            FROM {source} q CROSS JOIN {chunks} c
            LEFT JOIN {name}_dots d ON d.query_id = q.query_id AND d.chunk_key = c.chunk_key
            LEFT JOIN {name}_norms qn ON qn.query_id = q.query_id
            LEFT JOIN {norms} cn ON cn.chunk_key = c.chunk_key))
        WHERE rank <= 5""",
    )
    CTES[f"{name}_text"] = (
        [name, chunks],
        f"SELECT h.*, c.chunked_text FROM {name} h JOIN {chunks} c ON c.chunk_key = h.chunk_key",
    )
    CTES[f"{name}_context"] = (
        [f"{name}_text"],
        f"""SELECT query_id, string_agg(chunked_text, {NL} || {NL} ORDER BY rank) AS context_text,
          count(*) AS context_documents, arg_min(chunk_key, rank) AS best_chunk, arg_min(score, rank) AS best_score
        FROM {name}_text GROUP BY query_id""",
    )
    CTES[f"{name}_sentences"] = (
        [f"{name}_text"],
        rf"""SELECT query_id, rank, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (
          SELECT query_id, rank, list_filter(list_transform(
            regexp_extract_all(chunked_text, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: {strip('x')}), lambda x: x <> '') AS s
          FROM {name}_text)""",
    )
    CTES[f"{name}_answers"] = (
        [f"{name}_sentences", source],
        f"""SELECT query_id, sentence AS answer FROM (
          SELECT s.query_id, sentence, row_number() OVER (PARTITION BY s.query_id ORDER BY
            len(list_intersect({words('s.sentence')}, {words('q.question')})) DESC, rank, pos) AS place
          FROM {name}_sentences s JOIN {source} q ON q.query_id = s.query_id)
        WHERE place = 1""",
    )
    CTES[f"{name}_prompts"] = (
        [f"{name}_context", source],
        f"""SELECT q.query_id, {_PROMPT} AS prompt
        FROM {source} q LEFT JOIN {name}_context c ON c.query_id = q.query_id""",
    )


_search("hits", "questions")
_search("hits_gaps", "questions_gaps")

# Rules and questions in Japanese.
TOPICS = ("通勤手当", "年次有給休暇", "出張旅費", "住宅手当", "時間外勤務", "育児休業", "退職金", "健康診断", "カタカナ表記", "ボーナス", "服務規律", "テレワーク")
_TOPIC = f"[{', '.join(repr(t) for t in TOPICS)}][({{}}) % {len(TOPICS)} + 1]"
CTES["rules"] = (
    [],
    f"""SELECT doc_id || ':0' AS chunk_key, '第' || doc_id || '条（' || {_TOPIC.format('doc_id')} || '）:' || {NL} || {_TOPIC.format('doc_id')}
      || 'は月額' || n_chars || '円とし、' || source || 'が支給する。' || {_TOPIC.format('doc_id * 7 + 3')} || 'については別に定める。' || text AS chunked_text
    FROM documents""",
)
CTES["rule_questions"] = (
    [],
    f"""SELECT conv_id AS query_id, {_TOPIC.format('conv_id')} || 'はいくらですか。' || (conv_id % 7) || '条の' || {_TOPIC.format('conv_id * 5 + 1')} || 'も教えてください。' AS question
    FROM conversations GROUP BY conv_id""",
)
CTES["rule_counts"] = (
    ["rules"],
    f"""SELECT chunk_key, ('0x' || left(md5(word), 6))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS n
    FROM (SELECT chunk_key, unnest({all_words('chunked_text')}) AS word FROM rules) GROUP BY ALL""",
)
CTES["rule_norms"] = (
    ["rule_counts"],
    "SELECT chunk_key, sqrt(sum(n * n)) AS norm, sum(n * n) AS squares FROM rule_counts GROUP BY chunk_key",
)
_search("rule_hits", "rule_questions", "rules", "rule_counts", "rule_norms")


def _vector_hits(score: str, value: str, order: str) -> str:
    return f"""SELECT query_id, chunk_key, score, rank FROM (
      SELECT query_id, chunk_key, score,
        row_number() OVER (PARTITION BY query_id ORDER BY {without_noise('value')} {order}, chunk_key) AS rank
      FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_key, round({score}, 6) + 0.0 AS score, {value} AS value
        FROM embeddings q CROSS JOIN embeddings c))
    WHERE rank <= 5"""


_A, _C = "q.embedding::DOUBLE[]", "c.embedding::DOUBLE[]"
_DOT, _OWN = f"list_dot_product({_A}, {_C})", f"list_dot_product({_C}, {_C})"
_COSINE = f"{_DOT} / (sqrt(list_dot_product({_A}, {_A})) * sqrt({_OWN}))"
_APART = f"list_sum(list_transform(list_zip({_A}, {_C}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"

_SIGNS = "list_transform(range(64), lambda j: 1.0 - 2.0 * (('0x' || left(md5(p || ':' || j), 1))::BIGINT % 2))"
CTES["directions"] = ([], f"SELECT p, {_SIGNS}::DOUBLE[] AS d FROM (SELECT unnest(range(6)) AS p)")
CTES["cells"] = (
    ["directions"],
    """SELECT vec_id, any_value(embedding)::DOUBLE[] AS v,
      sum(CASE WHEN list_dot_product(embedding::DOUBLE[], d) > 0 THEN 1 << p ELSE 0 END)::BIGINT AS cell
    FROM embeddings CROSS JOIN directions GROUP BY vec_id""",
)
CTES["cell_sizes"] = (["cells"], "SELECT cell, count(*) AS n FROM cells GROUP BY cell")
CTES["reaches"] = (
    ["cell_sizes"],
    """SELECT cell, min(r) AS reach FROM (
      SELECT a.cell, r.r, sum(b.n) FILTER (WHERE bit_count(xor(a.cell, b.cell)) <= r.r) AS held
      FROM cell_sizes a CROSS JOIN cell_sizes b CROSS JOIN (SELECT unnest(range(7)) AS r) r GROUP BY ALL)
    WHERE r >= 1 AND (held >= 5 OR r = 6) GROUP BY cell""",
)

# Evaluation examples and predictions.
CTES["examples"] = (
    [],
    """SELECT conv_id, question, reply,
      [coalesce(array_to_string(list_slice(string_split(reply, ' '), 1, 5), ' '), 'no reply'), string_split(question, ' ')[-1]] AS facts,
      'c' || (conv_id % 5) AS category,
      CASE conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
    FROM (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question,
        arg_max(text, turn) FILTER (WHERE role = 'assistant') AS reply FROM conversations GROUP BY conv_id)""",
)
CTES["paired"] = (
    ["examples"],
    """SELECT e.*, coalesce(e.reply, '') AS answer, CASE WHEN e.reply IS NOT NULL THEN c.first END AS context_text
    FROM examples e JOIN (SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id) c
      ON c.conv_id = e.conv_id""",
)


def covered(of: str, by: str) -> str:
    a, b = words(of), words(by)
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


def band(share: str) -> str:
    return f"CASE WHEN {share} = 1 THEN 'excellent' WHEN {share} >= 0.5 THEN 'good' WHEN {share} > 0 THEN 'acceptable' ELSE 'poor' END"


CTES["scored"] = (
    ["paired"],
    f"""SELECT *, len(list_filter(facts, lambda f: contains(answer, f)))::DOUBLE / len(facts) AS accuracy_share,
      {covered('question', 'answer')} AS relevance,
      {covered('answer', "coalesce(context_text, '')")} AS grounding_share
    FROM paired""",
)
CTES["scores"] = (
    ["scored"],
    f"""SELECT *, CASE WHEN accuracy_share = 1 THEN 1 ELSE 0 END::BIGINT AS accuracy, {band('grounding_share')} AS grounding
    FROM scored""",
)
CTES["metric_rows"] = (
    ["scores"],
    """SELECT unnest(['accuracy_evaluator/mean', 'accuracy_share/mean', 'relevance_evaluator/mean', 'grounding_share/mean']) AS metric,
      unnest([round(avg(accuracy), 6), round(avg(accuracy_share), 6), round(avg(relevance), 6), round(avg(grounding_share), 6)]) AS value
    FROM scores""",
)


CTES["engine_scores"] = (
    ["examples", "hits_answers", "hits_context"],
    f"""SELECT *, {band('grounding_share')} AS grounding FROM (
      SELECT *, len(list_filter(facts, lambda f: contains(answer, f)))::DOUBLE / len(facts) AS accuracy_share,
        {covered('question', 'answer')} AS relevance, {covered('answer', 'context_text')} AS grounding_share
      FROM (SELECT e.*, coalesce(a.answer, '') AS answer, coalesce(c.context_text, '') AS context_text FROM examples e
        LEFT JOIN hits_answers a ON a.query_id = e.conv_id LEFT JOIN hits_context c ON c.query_id = e.conv_id))""",
)


CTES["replies"] = (
    [],
    f"""SELECT conv_id, turn, answer || ' ' || array_to_string(list_slice(string_split(before, ' '), 1, 12), ' ') || '.' AS answer, before FROM (
      SELECT m.conv_id, m.turn, any_value(m.text) AS answer, coalesce(string_agg(b.text, {NL} ORDER BY b.turn), '') AS before
      FROM conversations m LEFT JOIN conversations b ON b.conv_id = m.conv_id AND b.turn < m.turn
      WHERE m.role = 'assistant' GROUP BY m.conv_id, m.turn)""",
)
CTES["reply_sentences"] = (
    ["replies"],
    rf"""SELECT conv_id, turn, unnest(range(len(s))) AS sentence_no, unnest(s) AS sentence FROM (
      SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(answer, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: {strip('x')}),
        lambda x: len({all_words('x')}) > 0) AS s FROM replies)""",
)
CTES["reply_words"] = (
    ["reply_sentences"],
    f"""SELECT conv_id, turn, sentence_no, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
      SELECT *, {all_words('sentence')} AS w FROM reply_sentences)""",
)
CTES["context_words"] = (
    ["replies"],
    f"""SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS j FROM (SELECT *, {all_words('before')} AS w FROM replies)""",
)
CTES["reply_runs"] = (
    ["reply_words", "context_words"],
    """SELECT conv_id, turn, sentence_no, count(*) AS run, min(j) AS place, string_agg(word, ' ' ORDER BY j) AS evidence FROM (
      SELECT a.conv_id, a.turn, a.sentence_no, a.word, c.j, c.j - a.i AS slant,
        a.i - row_number() OVER (PARTITION BY a.conv_id, a.turn, a.sentence_no, c.j - a.i ORDER BY a.i) AS island
      FROM reply_words a JOIN context_words c ON c.conv_id = a.conv_id AND c.turn = a.turn AND c.word = a.word)
    GROUP BY conv_id, turn, sentence_no, slant, island""",
)
CTES["aligned"] = (
    ["reply_sentences", "reply_runs"],
    f"""SELECT s.*, len({all_words('sentence')}) AS n_words, coalesce(r.run, 0) AS run, coalesce(r.place, -1) AS evidence_at,
      coalesce(r.evidence, '') AS evidence, coalesce(r.run, 0) * 2 >= len({all_words('sentence')}) AS covered
    FROM reply_sentences s LEFT JOIN (SELECT * FROM reply_runs
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn, sentence_no ORDER BY run DESC, place) = 1) r
      ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.sentence_no = s.sentence_no""",
)


def pieces(name: str, rows: str, needs: list[str]) -> None:
    """Stream pieces of ``rows(conv_id, message_id, question, answer)``, by taking the runs one after the other."""
    CTES[f"{name}_rows"] = (needs, rows)
    CTES[f"{name}_runs"] = (
        [f"{name}_rows"],
        rf"""SELECT conv_id, message_id, regexp_extract_all(answer, '[^。！？\n]+|[。！？\n]') AS runs
        FROM {name}_rows WHERE question <> ''""",
    )
    text = "s.held || p.runs[s.i + 1]"
    full = f"(length({text}) > 10 OR p.runs[s.i + 1] IN ('。', '！', '？', {NL}))"
    send = f"({full} AND NOT {is_blank(text)})"
    CTES[f"{name}_steps"] = (
        [f"{name}_runs"],
        f"""SELECT message_id, 0::BIGINT AS i, ''::VARCHAR AS held, NULL::VARCHAR AS sent FROM {name}_runs
        UNION ALL
        SELECT s.message_id, s.i + 1, CASE WHEN {send} THEN '' ELSE {text} END, CASE WHEN {send} THEN {text} END
        FROM {name}_steps s JOIN {name}_runs p ON p.message_id = s.message_id WHERE s.i < len(p.runs)""",
    )
    CTES[f"{name}_sent"] = (
        [f"{name}_steps", f"{name}_runs"],
        f"""SELECT message_id, i, sent AS content FROM {name}_steps WHERE sent IS NOT NULL
        UNION ALL
        SELECT s.message_id, s.i + 1, s.held FROM {name}_steps s JOIN {name}_runs p ON p.message_id = s.message_id
        WHERE s.i = len(p.runs) AND NOT {is_blank('s.held')}""",
    )
    CTES[name] = (
        [f"{name}_sent", f"{name}_rows"],
        f"""SELECT r.conv_id, s.message_id, row_number() OVER (PARTITION BY s.message_id ORDER BY i) - 1 AS pos, s.content
        FROM {name}_sent s JOIN {name}_rows r ON r.message_id = s.message_id
        UNION ALL
        SELECT conv_id, message_id, 0, '{NO_MESSAGE}' FROM {name}_rows WHERE question = ''""",
    )


pieces(
    "message_pieces",
    """SELECT conv_id, md5(conv_id || '|' || turn) AS message_id, replace(text, '.', '。') AS answer,
      CASE WHEN role <> 'system' THEN replace(text, '.', '。') ELSE '' END AS question
    FROM conversations""",
    [],
)
pieces(
    "chat_pieces",
    """SELECT o.conv_id, md5(o.conv_id || '|' || o.last_turn) AS message_id, coalesce(a.answer, '') AS answer, o.question
    FROM opened_gaps o LEFT JOIN hits_gaps_answers a ON a.query_id = o.conv_id""",
    ["opened_gaps", "hits_gaps_answers"],
)

CTES["doc_buckets"] = (
    [],
    f"""SELECT doc_id, ('0x' || left(md5(word), 6))::BIGINT % 256 AS bucket, count(*)::DOUBLE AS value
    FROM (SELECT doc_id, unnest({all_words('text')}) AS word FROM documents) GROUP BY ALL""",
)
CTES["bucket_weights"] = (
    ["doc_buckets"],
    """SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf
    FROM doc_buckets GROUP BY bucket""",
)
CTES["weighted"] = (
    ["doc_buckets", "bucket_weights"],
    "SELECT doc_id, b.bucket, value * idf AS w FROM doc_buckets b JOIN bucket_weights i ON i.bucket = b.bucket",
)

CTES["pages_of"] = (
    [],
    f"""SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN turn % 3 = 2 THEN ' ' || {NL} ELSE text END AS text
    FROM conversations""",
)
CTES["old_docs"] = ([], "SELECT doc_id, text FROM documents WHERE lang <> 'fr'")
CTES["new_docs"] = (
    [],
    "SELECT doc_id, CASE WHEN source = 'src7' THEN text || ' x' ELSE text END AS text FROM documents WHERE lang <> 'es'",
)
CTES["layouts"] = (
    [],
    """SELECT layout, conv_id, turn, role, text,
      CASE layout
        WHEN 'nested' THEN CASE WHEN role IN ('user', 'assistant') THEN text ELSE 'N/A' END
        WHEN 'json' THEN CASE WHEN role IN ('user', 'assistant') THEN text ELSE 'N/A' END
        WHEN 'dict' THEN text WHEN 'text' THEN text WHEN 'columns' THEN role ELSE 'N/A' END AS question,
      CASE layout
        WHEN 'nested' THEN CASE WHEN role IN ('user', 'assistant') THEN text ELSE 'N/A' END
        WHEN 'json' THEN CASE WHEN role IN ('user', 'assistant') THEN text ELSE 'N/A' END
        WHEN 'dict' THEN '' WHEN 'text' THEN role WHEN 'columns' THEN text ELSE 'N/A' END AS answer
    FROM conversations CROSS JOIN (SELECT unnest(['nested', 'json', 'plain_request', 'dict', 'text', 'columns', 'none']) AS layout)""",
)


def query(final: str, *needs: str) -> str:
    """``final`` behind the expressions it needs, each once and in order of need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][0]:
                add(need)
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in ordered) + "\n" + final


def _streamed(documents: str) -> str:
    """Chunks of the streamed documents and the words of their vectors."""
    return rf"""SELECT chunk_key, chunked_text, len({all_words('chunked_text')})::DOUBLE AS words FROM (
      SELECT doc_id || ':' || pos AS chunk_key, chunked_text FROM (
        SELECT doc_id, unnest(s) AS chunked_text, unnest(range(len(s))) AS pos FROM (
          SELECT doc_id, list_filter(list_transform(string_split_regex({strip(f"replace(text, {NL}, {NL} || ' ' || {NL})")},
            '\n{B}*\n+'), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM {documents})))"""


ORACLES = {
    "file_select": query("SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'"),
    "path_validate": query("SELECT page_id, lower(url) LIKE '%.html' AS is_valid FROM pages"),
    "base_name": query(r"SELECT page_id, regexp_extract(url, '[^/]*$') AS base_name FROM pages"),
    "assemble_document": query(
        f"""SELECT doc_id, coalesce(string_agg(text, {NL} ORDER BY page_no) FILTER (WHERE NOT {is_blank('text')}), '') AS text,
          count(*) AS page_count FROM pages_of GROUP BY doc_id""",
        "pages_of",
    ),
    "document_stats": query(
        f"""SELECT doc_id, length(coalesce(string_agg(text, {NL}) FILTER (WHERE NOT {is_blank('text')}), ''))::BIGINT AS char_count,
          count(*) AS page_count FROM pages_of GROUP BY doc_id""",
        "pages_of",
    ),
    "eval_examples": query(
        "SELECT question, array_to_string(facts, '|') AS facts, category, difficulty FROM examples", "examples"
    ),
    "normalize_newlines": query(
        f"""SELECT doc_id, {strip(f"regexp_replace({NL} || '　' || replace(text, {NL}, {NL} || {NL} || {NL}) || ' ' || {NL}, '\n+', {NL}, 'g')")} AS text
        FROM documents"""
    ),
    "split_sections": query("SELECT doc_id, pos, section FROM sections", "sections"),
    "section_title": query("SELECT doc_id, pos, title FROM titled", "titled"),
    "section_content": query("SELECT doc_id, pos, content FROM parts", "parts"),
    "chunk_documents": query("SELECT chunk_key, doc_id, chunk_id, chunked_text, file_name FROM chunks", "chunks"),
    "chunk_pages": query("SELECT chunk_key, doc_id, chunk_id, chunked_text FROM chunks", "chunks"),
    "chunk_count": query(
        """SELECT d.doc_id, count(c.chunk_id) AS chunks FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id
        GROUP BY d.doc_id""",
        "chunks",
    ),
    "cast_embedding": query(
        "SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS value FROM embeddings"
    ),
    "truncate_answer": query(
        "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS short FROM conversations"
    ),
    "hash_embed": query("SELECT * FROM doc_buckets", "doc_buckets"),
    "japanese_embed": query("SELECT chunk_key, bucket, n AS value FROM rule_counts", "rule_counts"),
    "japanese_answers": query(
        f"""SELECT query_id, question, best_chunk, best_score, answer, {covered('question', 'answer')} AS relevance,
          {covered('answer', 'context_text')} AS grounding_share
        FROM (SELECT q.query_id, q.question, c.best_chunk, c.best_score, coalesce(a.answer, '') AS answer, c.context_text
          FROM rule_questions q JOIN rule_hits_context c ON c.query_id = q.query_id
            LEFT JOIN rule_hits_answers a ON a.query_id = q.query_id)""",
        "rule_questions",
        "rule_hits_context",
        "rule_hits_answers",
    ),
    "topk_certified": _vector_hits(_COSINE, f"{_DOT} * abs({_DOT}) / {_OWN}", "DESC"),
    "embed_udf": query(
        """SELECT doc_id, code - 97 AS bucket, count(*)::DOUBLE AS value
        FROM (SELECT doc_id, ascii(unnest(regexp_extract_all(text, '[a-z]')))::BIGINT AS code FROM documents) GROUP BY ALL"""
    ),
    "tfidf_embed": query(
        """SELECT doc_id, bucket, round((w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS value
        FROM weighted WHERE w <> 0""",
        "weighted",
    ),
    "topk_dense": _vector_hits(_COSINE, f"{_DOT} * abs({_DOT}) / {_OWN}", "DESC"),
    "topk_blocks": _vector_hits(_COSINE, f"{_DOT} * abs({_DOT}) / {_OWN}", "DESC"),
    "topk_dot": _vector_hits(_DOT, _DOT, "DESC"),
    "topk_l2": _vector_hits(f"sqrt({_APART})", _APART, "ASC"),
    "topk_lsh": query(
        f"""SELECT query_id, chunk_key, score, rank FROM (
          SELECT query_id, chunk_key, score,
            row_number() OVER (PARTITION BY query_id ORDER BY {without_noise('value')} DESC, chunk_key) AS rank
          FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_key, round(list_dot_product(q.v, c.v)
              / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 6) + 0.0 AS score,
              list_dot_product(q.v, c.v) * abs(list_dot_product(q.v, c.v)) / list_dot_product(c.v, c.v) AS value
            FROM cells q JOIN reaches r ON r.cell = q.cell JOIN cells c ON bit_count(xor(q.cell, c.cell)) <= r.reach))
        WHERE rank <= 5""",
        "cells",
        "reaches",
    ),
    "topk_sparse": query("SELECT query_id, chunk_key, score, rank FROM hits", "hits"),
    "topk_lists": query("SELECT query_id, chunk_key, score, rank FROM hits", "hits"),
    "retrieve_with_text": query("SELECT query_id, chunk_key, score, rank, chunked_text FROM hits_text", "hits_text"),
    "context_count": query(
        """SELECT o.conv_id AS query_id, count(h.chunk_key) AS context_documents
        FROM opened_gaps o LEFT JOIN hits_gaps h ON h.query_id = o.conv_id GROUP BY o.conv_id""",
        "opened_gaps",
        "hits_gaps",
    ),
    "stuff_context": query("SELECT query_id, context_text FROM hits_context", "hits_context"),
    "render_prompt": query("SELECT query_id, prompt FROM hits_prompts", "hits_prompts"),
    "extractive_answer": query(
        "SELECT o.query_id, coalesce(a.answer, '') AS answer FROM opened o LEFT JOIN hits_answers a ON a.query_id = o.query_id",
        "opened",
        "hits_answers",
    ),
    "answer_questions": query(
        """SELECT o.query_id AS conv_id, o.question, c.context_documents, c.best_chunk, c.best_score,
          length(p.prompt)::BIGINT AS prompt_chars, coalesce(a.answer, '') AS answer
        FROM opened o LEFT JOIN hits_context c ON c.query_id = o.query_id
          LEFT JOIN hits_prompts p ON p.query_id = o.query_id LEFT JOIN hits_answers a ON a.query_id = o.query_id""",
        "opened",
        "hits_context",
        "hits_prompts",
        "hits_answers",
    ),
    "generate_hook": query(
        f"""SELECT conv_id, turn, CASE WHEN text = '' THEN '' ELSE '質問: ' || replace(text, {NL}, ' ') END AS answer
        FROM conversations"""
    ),
    "guarded_predict": query(
        f"""SELECT conv_id, turn,
          CASE WHEN role = 'system' OR text = '' THEN '' WHEN length(text) % 5 = 0 THEN '{ERROR_PREFIX}' || length(text) || ' characters'
            WHEN length(text) % 5 = 1 THEN '' ELSE length(text)::VARCHAR END AS answer,
          CASE WHEN role <> 'system' AND text <> '' AND length(text) % 5 = 0 THEN length(text) || ' characters' END AS error
        FROM conversations"""
    ),
    "last_user_message": query("SELECT conv_id, last_turn, question FROM opened_gaps", "opened_gaps"),
    "chat_fallback": query(
        f"""SELECT conv_id, CASE WHEN question = '' THEN '{NO_MESSAGE}' ELSE 're: ' || question END AS content FROM opened_gaps""",
        "opened_gaps",
    ),
    "chat_reply": query(
        f"""SELECT conv_id, md5(conv_id || '|' || last_turn) AS id, 'assistant' AS role,
          CASE WHEN question = '' THEN '{NO_MESSAGE}' ELSE 're: ' || question END AS content FROM opened_gaps""",
        "opened_gaps",
    ),
    "stream_chunks": query("SELECT conv_id, message_id, pos, content FROM message_pieces", "message_pieces"),
    "run_evaluation": query("SELECT conv_id, question, answer, context_text FROM paired", "paired"),
    "score_accuracy": query("SELECT conv_id, accuracy_share, accuracy FROM scores", "scores"),
    "score_relevance": query("SELECT conv_id, relevance FROM scores", "scores"),
    "score_grounding": query(
        f"""SELECT conv_id, turn, grounding_share, {band('grounding_share')} AS grounding FROM (
          SELECT conv_id, turn, role, {covered('text', "coalesce(before, '')")} AS grounding_share
          FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations))
        WHERE role = 'assistant'"""
    ),
    "align_answers": query(
        "SELECT conv_id, turn, sentence_no, sentence, n_words, run, evidence_at, evidence, covered FROM aligned", "aligned"
    ),
    "score_alignment": query(
        f"""SELECT conv_id, turn, covered_share, {band('covered_share')} AS alignment FROM (
          SELECT r.conv_id, r.turn, round(coalesce(avg(a.covered::INT), 0.0), 6) AS covered_share
          FROM replies r LEFT JOIN aligned a ON a.conv_id = r.conv_id AND a.turn = r.turn GROUP BY r.conv_id, r.turn)""",
        "replies",
        "aligned",
    ),
    "eval_metrics": query("SELECT metric, value FROM metric_rows", "metric_rows"),
    "metrics_by_tag": query(
        """SELECT category, difficulty, count(*) AS examples, round(avg(accuracy_share), 6) AS accuracy_share,
          round(avg(relevance), 6) AS relevance, round(avg(grounding_share), 6) AS grounding_share
        FROM scores GROUP BY GROUPING SETS ((category), (difficulty), ())""",
        "scores",
    ),
    "evaluate_answers": query(
        """SELECT conv_id, answer, accuracy_share, relevance, grounding_share, grounding, logged FROM engine_scores CROSS JOIN (
          SELECT 'accuracy_evaluator/mean=' || round(avg(CASE WHEN accuracy_share = 1 THEN 1 ELSE 0 END), 6)::DOUBLE
            || ',accuracy_share/mean=' || round(avg(accuracy_share), 6)::DOUBLE || ',grounding_share/mean=' || round(avg(grounding_share), 6)::DOUBLE
            || ',relevance_evaluator/mean=' || round(avg(relevance), 6)::DOUBLE AS logged FROM engine_scores)""",
        "engine_scores",
    ),
    "extract_question": query("SELECT layout, conv_id, turn, question FROM layouts", "layouts"),
    "extract_answer": query(
        "SELECT layout, conv_id, turn, CASE WHEN layout = 'dict' AND role = 'answer' THEN text ELSE answer END AS answer FROM layouts",
        "layouts",
    ),
    "score_columns": query(
        "SELECT conv_id, accuracy::VARCHAR AS accuracy, grounding_share::VARCHAR AS grounding, 'N/A' AS fluency FROM scores", "scores"
    ),
    "eval_report": query(
        """SELECT row_number() OVER (ORDER BY conv_id) AS number, question,
          CASE WHEN length(answer) > 300 THEN left(answer, 300) || '...' ELSE answer END AS answer,
          accuracy::VARCHAR AS accuracy, round(relevance, 6) AS relevance, grounding FROM scores""",
        "scores",
    ),
    "eval_head": query(
        "SELECT conv_id, question, answer, context_text FROM paired ORDER BY conv_id LIMIT 5", "paired"
    ),
    "stringify_complex": query(
        """SELECT conv_id, to_json(struct_pack(question := question))::VARCHAR AS inputs,
          to_json(struct_pack(expected_facts := facts))::VARCHAR AS expectations,
          to_json(map(['category', 'difficulty'], [category, difficulty]))::VARCHAR AS tags FROM examples""",
        "examples",
    ),
    "run_stats": query(
        """SELECT 'examples' AS name, count(*) AS value FROM paired
        UNION ALL SELECT 'empty_answers', count(*) FILTER (WHERE answer = '') FROM paired""",
        "paired",
    ),
    "save_roundtrip": query(
        """SELECT c.chunk_key, c.doc_id, c.chunk_id, c.chunked_text, c.file_name, coalesce(n.words, 0.0) AS words
        FROM chunks c LEFT JOIN (SELECT chunk_key, sum(n) AS words FROM chunk_counts GROUP BY chunk_key) n
          ON n.chunk_key = c.chunk_key""",
        "chunks",
        "chunk_counts",
    ),
    "saved_count": query("SELECT count(*) AS count FROM chunks", "chunks"),
    "chunk_preview": query(
        """SELECT chunk_key, file_name, length(chunked_text)::BIGINT AS text_length, 256::BIGINT AS embedding_dim
        FROM chunks ORDER BY chunk_key LIMIT 5""",
        "chunks",
    ),
    "embedding_dim": query("SELECT min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings"),
    "change_feed": query(
        """SELECT n.doc_id, n.text, 'insert' AS _change_type FROM new_docs n WHERE n.doc_id NOT IN (SELECT doc_id FROM old_docs)
        UNION ALL SELECT o.doc_id, o.text, 'delete' FROM old_docs o WHERE o.doc_id NOT IN (SELECT doc_id FROM new_docs)
        UNION ALL SELECT o.doc_id, o.text, 'update_preimage' FROM old_docs o JOIN new_docs n ON n.doc_id = o.doc_id WHERE n.text <> o.text
        UNION ALL SELECT n.doc_id, n.text, 'update_postimage' FROM old_docs o JOIN new_docs n ON n.doc_id = o.doc_id WHERE n.text <> o.text""",
        "old_docs",
        "new_docs",
    ),
    "build_index": query(
        f"""SELECT vec_id AS chunk_key, len(embedding) AS dim,
          round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings"""
    ),
    "index_documents": query(
        """SELECT c.chunk_key, round(coalesce(n.norm, 0.0), 6) AS norm FROM chunks c
        LEFT JOIN chunk_norms n ON n.chunk_key = c.chunk_key""",
        "chunks",
        "chunk_norms",
    ),
    "sync_index": query(
        """SELECT vec_id AS chunk_key, len(embedding) AS dim, round(CASE WHEN label = 2 THEN 2 ELSE 1 END
          * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings WHERE label <> 1"""
    ),
    "save_results": query(
        """SELECT conv_id, to_json(struct_pack(question := question))::VARCHAR AS inputs,
          to_json(struct_pack(expected_facts := facts))::VARCHAR AS expectations,
          to_json(map(['category', 'difficulty'], [category, difficulty]))::VARCHAR AS tags, answer, accuracy_share FROM scores""",
        "scores",
    ),
    "run_log": query(
        """SELECT 'evaluation' AS run_name, 'metric' AS kind, metric AS key, NULL::VARCHAR AS value, value AS number FROM metric_rows
        UNION ALL SELECT 'evaluation', 'tag', 'task', 'evaluation', NULL
        UNION ALL SELECT 'evaluation', 'tag', 'evaluation_type', 'answer_quality', NULL
        UNION ALL SELECT 'evaluation', 'table', 'eval_results_table',
          to_json(struct_pack(conv_id := conv_id, answer := answer))::VARCHAR, NULL FROM scores""",
        "metric_rows",
        "scores",
    ),
    "chat_stream": query("SELECT conv_id, message_id, pos, content FROM chat_pieces", "chat_pieces"),
    "index_stream": _streamed("documents"),
    "reindex_stream": query(_streamed("new_docs"), "new_docs"),
}
