"""Rows as text and text as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import literal_array, named, seeded_hash, seeded_uniform, strip_blanks, unescape_newlines
from veritab.operators.profile import MISSING, TableProfile
from veritab.session import spread

PLACEHOLDER = "placeholder"
# Type marks of a cell and the frame of a row.
TYPE_TOKENS = {"numerical": "[NUM]", "categorical": "[CAT]", "mixed": "[MIX]"}
ROW_START, ROW_END, CELL_END = "[BOS]", "[EOS]", "[EOC]"
NOTHING_LEFT = -1


@dataclass(frozen=True)
class Style:
    """Separators of one text style and its prompt templates."""

    key_value: str
    between: str
    prefix: str
    key_prompt: tuple[str, str]
    pair_prompt: tuple[str, str, str]


STYLES = {
    "great": Style("is", ", ", "", ("", " is"), ("", " is ", ",")),
    "list": Style(":", "\n", "", ("", " :"), ("", " : ", "\n")),
    "text": Style("is", ".", "The", ("The ", " is"), ("The ", " is ", ".")),
    "apval": Style(":", ",", "", ("", " :"), ("", " : ", ",")),
}


def cell_text(name: str) -> Column:
    """Trimmed value, `Missing` for NULL."""
    return F.coalesce(strip_blanks(named(name).cast("string")), F.lit(MISSING))


def shuffled(entries: Column, seed: int | None, keys: list[str]) -> Column:
    """Per-row order of the cells from a seeded hash of the row keys and the column name."""
    if seed is None:
        return entries
    placed = F.transform(
        entries, lambda e: F.struct(seeded_hash(seed, e["key"], *[named(k) for k in keys]).alias("o"), e.alias("e"))
    )
    return F.transform(F.array_sort(placed), lambda p: p["e"])


def row_cells(columns: list[str], profile: TableProfile | None) -> Column:
    """Cells of a row as structs (key, value, token)."""
    cells = []
    for c in columns:
        token = TYPE_TOKENS[profile.of(c).kind] if profile is not None else ""
        cells.append(F.struct(F.lit(c).alias("key"), cell_text(c).alias("value"), F.lit(token).alias("token")))
    return F.array(*cells)


def serialize(
    df: DataFrame, profile: TableProfile, style: str = "great", columns: list[str] | None = None, seed: int | None = None,
    keys: list[str] | None = None, output: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """One text per row.

    `apval` lists all names, then all values.  The others write
    `[BOS] <type> name sep value [EOC] ... [EOS]` (Q10: blanks around the separator).
    """
    columns = columns or [p.name for p in profile.columns.values()]
    form = STYLES[style]
    cells = shuffled(row_cells(columns, profile), seed, keys or [])
    kept = [named(c) for c in (keep if keep is not None else df.columns)]
    staged = df.select(*kept, cells.alias("__cells"))
    if style == "apval":
        glue = f"{form.between} "
        text = F.concat(
            F.lit(" "), F.array_join(F.transform("__cells", lambda c: c["key"]), glue), F.lit(f" {form.key_value} "),
            F.array_join(F.transform("__cells", lambda c: c["value"]), glue),
        )
    else:
        body = F.array_join(
            F.transform(
                "__cells",
                lambda c: F.concat_ws(" ", c["token"], c["key"], F.lit(form.key_value), c["value"], F.lit(CELL_END)),
            ),
            " ",
        )
        text = F.concat_ws(" ", F.lit(ROW_START), body, F.lit(ROW_END))
    return staged.select(*[c for c in kept], text.alias(output))


def parsed_cells(text: Column, style: str) -> Column:
    """U4: text to an array of (key, value); a key without a value has a NULL value."""
    form = STYLES[style]
    if style == "apval":
        halves = F.split(text, f" {form.key_value} ", 3)
        names = F.split(F.trim(F.get(halves, F.lit(0))), form.between)
        values = F.split(F.trim(F.get(halves, F.lit(1))), form.between)
        return F.transform(
            names, lambda name, i: F.struct(F.trim(name).alias("key"), F.trim(F.get(values, i)).alias("value"))
        )
    def cells(parts: Column, pieces: int) -> Column:
        def bare(part: Column) -> Column:
            text = strip_blanks(F.regexp_replace(strip_blanks(part), r"^\[(NUM|CAT|MIX)\]\s*", ""))
            return strip_blanks(F.regexp_replace(text, f"^{form.prefix} ", "")) if form.prefix else text

        # an array of its own, so that a part is cleaned and split once for its key and its value
        split = F.transform(parts, lambda part: F.split(bare(part), f" {form.key_value} ", pieces))
        return F.transform(split, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value")))

    # framed cells keep everything after the first separator, free ones the second piece
    framed = F.split(F.regexp_replace(text, r"\[(BOS|EOS)\]", ""), _quoted(CELL_END))
    return F.when(F.contains(text, F.lit(CELL_END)), cells(framed, 2)).otherwise(cells(F.split(text, _quoted(form.between)), 3))


def _quoted(separator: str) -> str:
    return "".join(f"\\{ch}" if ch in ".[]|*+?()^$" else ch for ch in separator)


def deserialize(
    df: DataFrame, text: str, columns: list[str], style: str = "great", first_wins: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Texts to rows of text cells.

    Unknown names are ignored; of several values of a name the last (T3) or first (T4)
    counts; a name that never came with a value is `placeholder`.  In `apval` a name
    without a value is NULL.
    """
    return _read_back(spread(df), text, columns, style, first_wins, keep)


def _read_back(df: DataFrame, text: str, columns: list[str], style: str, first_wins: bool = False, keep: list[str] | None = None) -> DataFrame:
    kept = [named(c) for c in keep or []]
    cells = df.select(*kept, parsed_cells(named(text), style).alias("__cells"))
    position = 1 if first_wins else -1

    def value_of(c: str) -> Column:
        if style == "apval":
            hits = F.filter("__cells", lambda e: e["key"] == F.lit(c))
            return F.when(F.size(hits) == 0, PLACEHOLDER).otherwise(F.try_element_at(hits, F.lit(position))["value"])
        hits = F.filter("__cells", lambda e: (e["key"] == F.lit(c)) & e["value"].isNotNull())
        return F.coalesce(F.try_element_at(hits, F.lit(position))["value"], F.lit(PLACEHOLDER))

    return cells.select(*kept, *[value_of(c).alias(c) for c in columns])


def round_trip_failures(df: DataFrame, profile: TableProfile, keys: list[str], style: str = "great", seed: int | None = None) -> DataFrame:
    """Rows whose text does not parse back to the same cells."""
    columns = [p.name for p in profile.columns.values()]
    expected = [F.struct(F.lit(c).alias("key"), cell_text(c).alias("value")) for c in columns]
    staged = spread(df).select(*[named(k) for k in keys], *[named(c) for c in columns if c not in keys], F.array(*expected).alias("__expected"))
    texts = serialize(staged, profile, style, columns, seed, keys, keep=[*keys, "__expected"])
    back = _read_back(texts, "text", columns, style, keep=["__expected"])
    found = F.array(*[F.struct(F.lit(c).alias("key"), named(c).alias("value")) for c in columns])
    return back.filter(~(found == F.col("__expected"))).select(*[named(c) for c in columns])


def anchor_positions(df: DataFrame, text: str, cells: int, limit: int | None = None, output: str = "anchors", keep: list[str] | None = None) -> DataFrame:
    """Word positions of the type marks, padded with -1 where the text was cut at `limit` words."""
    kept = [named(c) for c in keep or []]
    words = F.split(named(text), " ")
    if limit is not None:
        words = F.slice(words, 1, limit)
    marks = literal_array(TYPE_TOKENS.values(), "string")
    staged = df.select(*kept, words.alias("__words"))
    places = F.filter(
        F.transform("__words", lambda w, i: F.when(F.array_contains(marks, w), i).otherwise(NOTHING_LEFT)), lambda i: i >= 0
    )
    padded = F.slice(F.concat(places, F.array_repeat(F.lit(-1), cells)), 1, cells)
    return staged.select(*kept, padded.alias(output))


def token_inventory(df: DataFrame, profile: TableProfile, style: str = "great") -> DataFrame:
    """Word counts by role (key, value, other) over all serialised rows.

    Counting happens on the cells before they are joined, so values are split once
    and the constant words of names and separators are counted arithmetically.
    """
    columns = [p.name for p in profile.columns.values()]
    form = STYLES[style]
    values = F.flatten(F.array(*[F.split(cell_text(c), r"\s+") for c in columns]))
    value_words = df.select(F.explode(values).alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("role", F.lit("value"))
    fixed: dict[tuple[str, str], int] = {}
    for c in columns:
        for word in c.split():
            fixed[("key", word)] = fixed.get(("key", word), 0) + 1
        for word in (TYPE_TOKENS[profile.of(c).kind], form.key_value, CELL_END):
            fixed[("other", word)] = fixed.get(("other", word), 0) + 1
    fixed[("other", ROW_START)] = fixed[("other", ROW_END)] = 1
    entries = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(word).alias("token"), F.lit(times).alias("times")) for (role, word), times in fixed.items()
    ])
    rows = df.agg(F.count("*").alias("rows")).select("rows", F.explode(entries).alias("e"))
    constant = rows.select("e.token", (F.col("rows") * F.col("e.times")).alias("n"), "e.role")
    return value_words.select("role", "token", "n").unionByName(constant.select("role", "token", "n"))


# --------------------------------------------------------------------- prompts
def key_prompt(name: Column, style: str) -> Column:
    before, after = STYLES[style].key_prompt
    return F.concat(F.lit(before), name, F.lit(after))


def pair_prompt(name: Column, value: Column, style: str) -> Column:
    before, middle, after = STYLES[style].pair_prompt
    return F.concat(F.lit(before), name, F.lit(middle), value, F.lit(after))


def start_with(columns: list[str], first: str) -> str:
    return ", ".join([first, *[c for c in columns if c.lower() != first.lower()]])


def start_prompts(
    ids: DataFrame, mode: str, columns: list[str], style: str = "great", start: str | None = None,
    value: Column | None = None, seed: int = 0, key: str = "id", custom: list[str] | None = None,
) -> DataFrame:
    """T5: one prompt per id.

    `default` opens a fixed column, `random` a drawn one; `categorical` and
    `continuous` give a drawn `value` of the start column (see `synth`), with
    `_and_random` followed by a random opening; `custom` repeats the given texts.
    """
    id_column = named(key)
    if style == "apval":
        # a drawn order of all names: sort by hash
        orders = F.array(*[F.struct(seeded_hash(seed, F.lit(c), id_column).alias("o"), F.lit(c).alias("c")) for c in columns])
        random_key = F.array_join(F.transform(F.array_sort(orders), lambda e: e["c"]), ", ")
    else:
        pick = F.floor(seeded_uniform(seed, id_column) * len(columns)).cast("int")
        random_key = F.get(literal_array(columns, "string"), pick)
    opening = F.lit(start_with(columns, start)) if style == "apval" and start else F.lit(start)
    if mode == "default":
        text = key_prompt(opening, style)
    elif mode == "random":
        text = key_prompt(random_key, style)
    elif mode in ("categorical", "continuous"):
        text = pair_prompt(opening, value.cast("string"), style)
    elif mode in ("categorical_and_random", "continuous_and_random"):
        text = pair_prompt(opening, value.cast("string"), style)
        if style != "apval":
            text = F.concat_ws(" ", text, key_prompt(random_key, style))
    elif mode == "custom":
        texts = literal_array(custom or [], "string")
        text = unescape_newlines(F.get(texts, F.pmod(id_column, F.lit(len(custom or []))).cast("int")))
    else:
        raise ValueError(f"unknown prompt mode {mode!r}")
    return ids.select(id_column, text.alias("prompt"))


def partial_prompts(
    df: DataFrame, columns: list[str], keys: list[str], style: str = "great", seed: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The known cells as text and one missing column as the open key.

    With a seed the known cells come in a drawn order and the open column is drawn;
    without one both follow column order.  A complete row has no open key.
    """
    kept = [named(c) for c in (keep if keep is not None else keys)]
    cells = F.array(*[F.struct(F.lit(c).alias("key"), named(c).cast("string").alias("value")) for c in columns])
    staged = df.select(*kept, shuffled(cells, seed, keys).alias("__cells"))
    staged = staged.select(
        *kept, F.filter("__cells", lambda c: c["value"].isNotNull()).alias("__known"),
        F.filter("__cells", lambda c: c["value"].isNull()).alias("__open"),
    )
    open_key = F.try_element_at("__open", F.lit(1))["key"]
    if style == "apval":
        names = F.array_join(
            F.concat(F.transform("__known", lambda c: c["key"]), F.transform("__open", lambda c: c["key"])), ", "
        )
        text = pair_prompt(names, F.array_join(F.transform("__known", lambda c: c["value"]), ", "), style)
    else:
        known = F.array_join(F.transform("__known", lambda c: pair_prompt(c["key"], c["value"], style)), " ")
        text = F.when(F.size("__open") > 0, F.concat_ws(" ", known, key_prompt(open_key, style))).otherwise(known)
    return staged.select(*kept, text.alias("prompt"), open_key.alias("open_column"))


def expand_prompts(prompts: DataFrame, instruction: str | None = None, examples: DataFrame | None = None, column: str = "prompt") -> DataFrame:
    """Instruction and example rows in front of each prompt.

    `examples` is a handful of texts (n-shot) in order of `position`; with both, they
    replace the `{}` of the instruction.
    """
    text = named(column)
    if examples is not None:
        shots = "\n".join(row["text"] for row in examples.orderBy("position").select("text").collect())
        if instruction is not None:
            text = F.concat(F.lit(instruction.replace("{}", shots)), text)
        else:
            text = F.concat(F.lit(shots + "\n"), text)
    elif instruction is not None:
        text = F.concat(F.lit(instruction), text)
    return prompts.withColumn(column, text)
