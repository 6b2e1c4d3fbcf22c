"""Chat formatting: schema fingerprints choose declarative mappings from many layouts to canonical turns.

A payload's fingerprint is the hash of its sorted nested field paths (objects and arrays opened, scalar types ignored),
taken from the schema of its JSON variant. A registry maps fingerprints to layouts; a layout says by paths where turns, roles
and texts are, so a new layout is one entry. Payloads of unknown layout, null and unparsable ones give one row
with null turn, role and text, so that nothing is lost silently.

The template marks every turn with a header and a footer. Control strings of common templates start with "<" or "[" and
one of ``NEXT``; where a text or role has such a start, with any backslashes between, one more backslash goes in, and
reading takes one out, so texts come back exactly and hold no control string while formatted. Line ends in roles
are percent-encoded. Null texts and roles are empty. Conversations are written turn by turn, so a
conversation of any length is never held whole; repeated (conversation, turn) rows stay, ordered by role and text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template.
HEAD, BREAK, FOOT = "<|im_start|>", "\n", "<|im_end|>\n"
NEXT = r"|/<sIS!"
TRAINED = "assistant"

#: Layouts: name -> (an example of every accepted set of fields, path of the list of turns or None for one turn,
#: [(path of role or a constant, path of text)] within the payload or one element).
LAYOUTS = {
    "turn": (['{"role":"","text":""}', '{"role":""}', '{"text":""}'], None, [("$.role", "$.text")]),
    "message": (['{"role":"","content":""}'], None, [("$.role", "$.content")]),
    "messages": (['{"messages":[{"role":"","content":""}]}'], "$.messages", [("$.role", "$.content")]),
    "conversations": (['{"conversations":[{"from":"","value":""}]}'], "$.conversations", [("$.from", "$.value")]),
    "prompt": (['{"prompt":"","completion":""}'], None, [("=user", "$.prompt"), ("=assistant", "$.completion")]),
    "response": (['{"prompt":"","response":""}'], None, [("=user", "$.prompt"), ("=assistant", "$.response")]),
    "instruction": (['{"instruction":"","output":""}'], None, [("=user", "$.instruction"), ("=assistant", "$.output")]),
    "instruction_input": (['{"instruction":"","input":"","output":""}'], None,
                          [("=user", "$.instruction"), ("=user", "$.input"), ("=assistant", "$.output")]),
    "question": (['{"system":"","question":"","answer":""}'], None, [("=system", "$.system"), ("=user", "$.question"), ("=assistant", "$.answer")]),
}
#: Names of roles in some layouts.
ROLES = {"human": "user", "gpt": "assistant"}


def fingerprint(payload: Column) -> Column:
    """Hash of the nested field paths of a variant; a variant's fields are sorted by name."""
    shape = F.regexp_replace(F.schema_of_variant(payload), r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]+\))?", ": *")
    return F.sha2(F.regexp_replace(shape, r"ARRAY<(?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]+\))?>", "ARRAY<*>"), 256)


def canonical_turns(rows: DataFrame, payload_col: str, layouts: dict | None = None) -> DataFrame:
    """Every row of ``rows`` once per turn of its JSON payload, with columns ``layout``, ``position`` (from 0), ``role``, ``text``."""
    layouts = layouts or LAYOUTS
    spark = rows.sparkSession
    samples = [(name, sample) for name, (accepted, _, _) in layouts.items() for sample in accepted]
    marks = spark.createDataFrame(samples, "name string, sample string").select("name", fingerprint(F.parse_json("sample")).alias("f")).collect()
    parsed = rows.withColumn("chat_payload", F.try_parse_json(F.col(payload_col)))
    parsed = parsed.withColumn("chat_mark", fingerprint(F.col("chat_payload")))
    layout = F.lit(None).cast("string")
    for name, f in marks:
        layout = F.when(F.col("chat_mark") == f, F.lit(name)).otherwise(layout)
    parsed = parsed.withColumn("layout", layout)

    def turn(at: Column, role: str, text: str) -> Column:
        who = F.lit(role[1:]) if role[0] == "=" else F.try_variant_get(at, role, "string")
        return F.struct(who.alias("role"), F.try_variant_get(at, text, "string").alias("text"))

    turns = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    for name, (_, path, parts) in layouts.items():
        if path is None:
            found = F.array(*(turn(F.col("chat_payload"), *p) for p in parts))
        else:
            found = F.transform(F.try_variant_get("chat_payload", path, "array<variant>"), _one(parts[0], turn))
        turns = F.when(F.col("layout") == name, found).otherwise(turns)
    out = parsed.select(*(F.col(f"`{c}`") for c in rows.columns), "layout", F.posexplode(turns).alias("position", "chat_turn"))
    role = F.col("chat_turn.role")
    for name, plain in ROLES.items():
        role = F.when(role == name, plain).otherwise(role)
    return out.withColumn("role", F.when(F.col("layout").isNotNull(), F.coalesce(role, F.lit("")))).withColumn(
        "text", F.when(F.col("layout").isNotNull(), F.coalesce(F.col("chat_turn.text"), F.lit("")))).drop("chat_turn")


def _one(part, turn):
    return lambda element: turn(element, *part)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?=[{NEXT}])", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?=[{NEXT}])", r"$1$2")


def _role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` (one marked turn; a conversation is the concatenation of its turns), and its loss mask:
    ``loss_start`` and ``loss_end`` (code points, end exclusive; null where the role isn't trained)."""
    head = F.concat(F.lit(HEAD), escape(_role(F.col("role"))), F.lit(BREAK))
    body = escape(F.col("text"))
    trained = F.col("role") == TRAINED
    return turns.withColumn("formatted", F.concat(head, body, F.lit(FOOT))).withColumn(
        "loss_start", F.when(trained, F.length(head)).cast("long")).withColumn("loss_end", F.when(trained, F.length(head) + F.length(body)).cast("long"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """From ``formatted`` turns: adds ``read_role`` and ``read_text``, and ``read_loss``, the unescaped text under the mask."""
    inner = F.expr(f"substring(formatted, {len(HEAD) + 1}, length(formatted) - {len(HEAD) + len(FOOT)})")
    cut = F.instr(inner, BREAK)
    return formatted.withColumn("read_role", _unrole(unescape(F.substring(inner, F.lit(1), cut - 1)))).withColumn(
        "read_text", unescape(F.substring(inner, cut + 1, F.length("formatted")))).withColumn(
        "read_loss", unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")))


def digests(read: DataFrame, conversation: str, order: list[str]) -> DataFrame:
    """Per conversation, from its turns read in order: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are dealt by conversation and sorted; hashes advance turn by turn."""

    def run(batches):
        key, state, out = None, None, []

        def close():
            if state:
                n, turns, chars, loss, size = state
                out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for k, role, text, loss, size in zip(*columns):
                if state is None or k != key:
                    close()
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += size
            if len(out) > 5000:
                yield pack(out)
                out = []
        close()
        yield pack(out)

    def pack(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out)) or [()] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)],
                               [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    dealt = read.repartition(F.col(conversation)).sortWithinPartitions(conversation, *order)
    return dealt.select(F.col(conversation).cast("long"), "read_role", "read_text", "read_loss", F.length("formatted").cast("long")).mapInArrow(
        run, f"`{conversation}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
