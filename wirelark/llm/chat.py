"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The turns of a conversation are rendered as
successively longer prefixes; where an output continues the one before, what it adds is the span of the new turn. The
place of the text in its span is found by rendering the turn with a letter for its text that the output does not hold:
what both outputs share in front and behind is the template's own. If an output does not start with the one before, the template rewrites
history: the turn is reported in ``rewritten``, and spans that the final output no longer holds are null.

Rows are dealt by conversation, sorted, and streamed. Rendering prefixes takes time with the square of the turns. A template
that declares ``by_turn`` (its output is the outputs of the single turns, one after the other) may be given parts of a
conversation: more than ``PART_TURNS`` turns are rendered in parts of so many, whose outputs follow each other as the whole would, in
the memory of one part. Any other template is given every prefix of the whole conversation, whatever its length, and makes one part.

Nulls and edge cases: a null role or text is empty; a null ``conv_id`` is a conversation of its own; turns are ordered by
``turn`` (nulls first), then role and text, and repeated rows are turns each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelark.llm.common import small_batches

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

PART_TURNS = 64
LOSS_ROLES = ("assistant",)
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of this template and of common chat formats. None may appear within a text.
CONTROL = (
    TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
_ESCAPED = re.compile(r"\\|" + "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_BACK = re.compile(r"\\(\\?)")
_READ = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.DOTALL)


@lru_cache(4 * PART_TURNS)  # prefixes repeat the same turns
def escape(text: str) -> str:
    """``text`` with every backslash doubled and one backslash put after the first character of a control string."""
    return _ESCAPED.sub(lambda m: m[0] * 2 or "\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def turn_template(turns: Turns) -> str:
    """The template of this package: each turn marked with its role, texts escaped."""
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}\n" for role, text in turns)


turn_template.by_turn = True

def read_turns(formatted: str) -> Turns:
    """The turns that ``turn_template`` was given."""
    return [(unescape(role), unescape(text)) for role, text in _READ.findall(formatted)]


def _shared(a: str, b: str) -> int:
    """Length of what ``a`` and ``b`` start with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _text_place(turns: Turns, output: str, template: Template) -> tuple[int, int]:
    """Where in ``output``, the rendered ``turns``, the text of the last turn stands."""
    letter = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in output)
    probe = template([*turns[:-1], (turns[-1][0], letter)])
    return _shared(output, probe), len(output) - _shared(output[::-1], probe[::-1])


def render(
    turns: Turns, template: Template, roles: Collection[str] | None = None
) -> tuple[str, list[tuple[int, int, int | None, int | None] | None], list[int]]:
    """The whole output; for each turn its span and the span of its text, or None; the turns that rewrite history.

    Texts are located for turns of the given ``roles`` (all by default). A turn that rewrites history has the span
    of its text only.
    """
    output, spans, rewritten = template([]), [], []
    for i, (role, _) in enumerate(turns):
        before, output = output, template(turns[: i + 1])
        place = (None, None) if roles is not None and role not in roles else _text_place(turns[: i + 1], output, template)
        if output.startswith(before):
            spans.append((len(before), len(output), *place) if place[0] is None or len(before) <= place[0] <= place[1] else None)
        else:
            rewritten.append(i)
            kept = _shared(before, output)
            spans = [s if s and s[1] <= kept else None for s in spans]
            # What lies before the text may be history: only the text's own place is certain.
            spans.append((*place, *place) if place[0] is not None and place[0] <= place[1] else None)
    return output, spans, rewritten


_PARTS = (
    "conv_id {kind}, part int, formatted string, spans array<struct<role: string, start: int, stop: int, text_start: int, text_stop: int>>,"
    " rewritten array<int>"
)
_SPAN = pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "stop", "text_start", "text_stop"))])


def _sorted(conversations: DataFrame) -> DataFrame:
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _parts(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[object, int, Turns]]:
    """Conversation, number of the part and turns (``most`` at a time, all if None), from sorted rows."""
    now, part, held = None, 0, None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if held is not None and (conv != now or len(held) == most):
                yield now, part, held
                part, held = (part + 1 if conv == now else 0), None
            now, held = conv, held or []
            held.append((role, text))
    if held:
        yield now, part, held


def format_conversations(
    conversations: DataFrame, template: Template = turn_template, roles: Collection[str] | None = LOSS_ROLES
) -> DataFrame:
    """``conv_id``, ``part``, ``formatted``, ``spans`` (role, span of the turn and of its text) and ``rewritten``.

    The loss mask of a part is the text spans of its turns of the given ``roles``. ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, part, turns in _parts(batches, most):
            output, spans, rewritten = render(turns, template, roles)
            named = [s and dict(zip(_SPAN.names, (role, *s), strict=True)) for (role, _), s in zip(turns, spans, strict=True)]
            values = [
                pa.array([conv], arrow), pa.array([part], pa.int32()), pa.array([output]), pa.array([named], pa.list_(_SPAN)),
                pa.array([rewritten], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(values, names=["conv_id", "part", "formatted", "spans", "rewritten"])

    from pyspark.sql.pandas.types import to_arrow_type

    most = PART_TURNS if getattr(template, "by_turn", False) else None
    kind = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    return _sorted(conversations).mapInArrow(of, _PARTS.format(kind=kind.simpleString()))


def read_back(formatted: DataFrame) -> DataFrame:
    """What is read back from the parts that ``format_conversations`` made, in their order: a row for each conversation.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, state):
            count, turns, chars, loss, length = state
            values = [pa.array([conv], arrow), *(pa.array([v]) for v in (count, turns.hexdigest(), chars, loss.hexdigest(), length))]
            return pa.RecordBatch.from_arrays(values, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now, state = None, None
        for batch in batches:
            for conv, part, output, spans in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "formatted", "spans")), strict=True):
                if part == 0:
                    if state:
                        yield row(now, state)
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(output):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    if span and span["role"] in LOSS_ROLES and span["text_start"] is not None:
                        text = unescape(output[span["text_start"] : span["text_stop"]])
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(output)
        if state:
            yield row(now, state)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    return formatted.mapInArrow(
        of, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))


_CONTROLS = "|".join(re.escape(c).replace("/", "/") for c in CONTROL)
_LENGTH = f"length({{x}}) + length(regexp_replace({{x}}, '[^\\\\]', '', 'g')) + len(regexp_extract_all({{x}}, '{_CONTROLS}'))"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(TURN) + len(TEXT) + len(END) + 1} + {_LENGTH.format(x="role")} + {_LENGTH.format(x="text")}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
