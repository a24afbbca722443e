"""Chat formatting in Spark expressions only.

One string per conversation. A block opens with ``<turn ROLE>`` and closes with
``</turn>`` and a newline; adjacent turns of one role share a block, their
texts parted by ``<part>``. Inside roles and texts ``&``, ``<`` and ``>`` are
written as ``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a control
string and ``read_back`` recovers every turn.

Defined results: turns are ordered by (turn, role, text), nulls first; repeated
rows are all kept; a null role or text counts as empty; a null conv_id is a
conversation of its own; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, PART, CLOSE = "<turn ", "<part>", "</turn>\n"


def _escape(sql: str) -> str:
    return f"replace(replace(replace({sql}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _unescape(sql: str) -> str:
    return f"replace(replace(replace({sql}, '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


#: Pieces whose lengths are summed at once.
STEP = 256
#: Code points of a part of a formatted string that is cut by itself.
CUT = 4096


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, once a row: a column that only a lambda uses would be made anew for each of its elements."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text).

    ``loss_spans`` lists (start, len) in code points, from 0, of the escaped
    texts of ``loss_role``, one for each turn. Time grows with a conversation's
    turns: blocks are slices of the sorted turns, and places are sums over whole
    steps of ``STEP`` pieces and a part of one. A conversation is one row, in
    memory as its formatted string is, so that string should be well below 2 GB.
    """
    role = loss_role.replace("\\", "\\\\").replace("'", "\\'")
    sorted_turns = turns.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "turn",
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    # where a block begins, and one place beyond the last
    begins = sorted_turns.select(
        "conv_id",
        "turns",
        F.expr(
            """concat(filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[if(i = 0, 0, i - 1)].role),
                      array(size(turns)))"""
        ).alias("begins"),
    )
    blocks = begins.select(
        "conv_id",
        F.expr(
            f"""transform(slice(begins, 1, size(begins) - 1), (b, k) -> named_struct(
                  'open', concat('{OPEN}', {_escape('turns[b].role')}, '>'),
                  'loss', turns[b].role = '{role}',
                  'parts', transform(slice(turns, b + 1, begins[k + 1] - b), t -> {_escape('t.text')})))"""
        ).alias("blocks"),
    )
    pieces = blocks.select(
        "conv_id",
        F.expr(f"array_join(transform(blocks, b -> concat(b.open, array_join(b.parts, '{PART}'), '</turn>\\n')), '')").alias("formatted"),
        F.expr(
            f"""flatten(transform(blocks, b -> transform(b.parts, (p, i) -> named_struct(
                  'lead', if(i = 0, length(b.open), {len(PART)}),
                  'len', length(p),
                  'all', if(i = 0, length(b.open), {len(PART)}) + length(p) + if(i = size(b.parts) - 1, {len(CLOSE)}, 0),
                  'loss', b.loss))))"""
        ).alias("pieces"),
    )

    def total(array: str) -> str:
        return f"aggregate({array}, 0L, (a, x) -> a + x)"

    sums = f"transform(sequence(0, (size(sizes) - 1) div {STEP}), c -> {total(f'slice(sizes, cast(c * {STEP} + 1 as int), {STEP})')})"
    bases = f"transform(sequence(0, size(sums) - 1), c -> {total('slice(sums, 1, c)')})"
    spans = f"""transform(filter(transform(pieces, (p, i) -> named_struct('p', p, 'i', i)), x -> x.p.loss), x -> named_struct(
                  'start', bases[x.i div {STEP}] + {total(f'slice(sizes, cast((x.i div {STEP}) * {STEP} + 1 as int), x.i % {STEP})')} + x.p.lead,
                  'len', cast(x.p.len as bigint)))"""
    placed = _let("sizes", "transform(pieces, p -> p.all)", _let("sums", sums, _let("bases", bases, spans)))
    return pieces.select("conv_id", "formatted", F.expr(placed).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) recovered from the formatted strings alone."""
    turn = "array<struct<role:string,text:string>>"
    # a place in a string is found by counting from its beginning, so spans are taken from parts of it
    parts = f"array_join(slice(cut, cast(s.start div {CUT} + 1 as int), cast((s.start + s.len) div {CUT} - s.start div {CUT} + 1 as int)), '')"
    span = f"substring({parts}, cast(s.start % {CUT} + 1 as int), cast(s.len as int))"
    return formatted.select(
        "conv_id",
        F.expr(
            f"""cast(flatten(transform(
                  filter(split(formatted, '</turn>\\n', -1), b -> b <> ''),
                  b -> transform(split(substring(b, instr(b, '>') + 1), '{PART}', -1),
                    p -> named_struct('role', {_unescape(f"substring(b, {len(OPEN) + 1}, instr(b, '>') - {len(OPEN) + 1})")},
                                      'text', {_unescape('p')})))) as {turn})"""
        ).alias("turns"),
        F.expr(_let("cut", f"regexp_extract_all(formatted, '(?s).{{1,{CUT}}}', 0)", f"array_join(transform(loss_spans, s -> {_unescape(span)}), '')")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts look like control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema
    )
    back = read_back(format_conversations(turns.unionByName(planted)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
OP8_SQL = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('text')}) + CASE WHEN before = role THEN {len(PART)}
    ELSE {len(OPEN) + 1 + len(CLOSE)} + length({_ESC.format('role')}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
