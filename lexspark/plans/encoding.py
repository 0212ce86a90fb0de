"""Examples as sequences of symbol numbers: vocabulary, encoding with a mask of what is predicted, counts of unknown symbols.

A sequence is <bos> source <sep> features <sep> target <eos>, or <bos> symbols <sep> target <eos> for equations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text

#: Special symbols and their numbers.
SPECIALS = ["<pad>", "<bos>", "<sep>", "<eos>", "<unk>"]
PAD, BOS, SEP, EOS, UNK = range(5)
FEATURE = "F:"


def example_symbols(characters: list[str], features: str | None) -> Column:
    """Array of the symbols of a row: characters of columns, and the parts of a comma-separated column of features."""
    own = F.concat(*[text.characters(F.coalesce(F.col(c), F.lit(""))) for c in characters])
    return own if features is None else F.concat(own, F.transform(F.split(features, ","), lambda f: F.concat(F.lit(FEATURE), f)))


def vocabulary(examples: DataFrame, characters: list[str], features: str | None) -> DataFrame:
    """(symbol, symbol_id): special symbols, then characters, then features, each in order. Distinct symbols only: at most 0x110000 characters and the features."""
    found = examples.select(F.explode(example_symbols(characters, features)).alias("symbol")).distinct()
    order = Window.orderBy(F.length("symbol") > 1, "symbol")
    own = found.select("symbol", (F.row_number().over(order) + len(SPECIALS) - 1).cast("int").alias("symbol_id"))
    return examples.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPECIALS)], "symbol string, symbol_id int").unionByName(own)


def encode(examples: DataFrame, vocab: DataFrame, prompt: list[tuple[str, bool]], target: str, width: int) -> DataFrame:
    """examples with tokens (padded to width), loss_mask, prompt_length and unknown, the number of symbols that aren't in the vocabulary.

    prompt: columns with whether they are features; a separator follows each. loss_mask is true at the places from which a symbol of the target
    (or its end) is predicted. A sequence over `width` fails. The vocabulary goes to every task as one map.
    """
    numbers = vocab.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "symbol_id"))).alias("_numbers"))
    number = lambda s: F.coalesce(F.try_element_at("_numbers", s), F.lit(UNK))
    of = lambda c, features: F.transform(F.split(c, ",") if features else text.characters(F.col(c)), lambda s: number(F.concat(F.lit(FEATURE), s) if features else s))
    parts = [F.array(F.lit(BOS))]
    for column, features in prompt:
        parts += [of(column, features), F.array(F.lit(SEP))]
    rows = examples.crossJoin(F.broadcast(numbers)).withColumns({"_prompt": F.concat(*parts), "_target": F.concat(of(target, False), F.array(F.lit(EOS)))})
    rows = rows.withColumns({"_all": F.concat("_prompt", "_target"), "prompt_length": F.size("_prompt")})
    size = F.size("_all")
    too_long = F.raise_error(F.concat(F.lit("sequence of length "), size.cast("string"), F.lit(f" is over {width}")))
    rows = rows.withColumns({
        "tokens": F.when(size <= width, F.concat("_all", F.array_repeat(F.lit(PAD), width - size))).otherwise(too_long.cast("array<int>")),
        "loss_mask": F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i >= F.col("prompt_length") - 1) & (i < size - 1)),
        "unknown": F.size(F.filter("_all", lambda x: x == UNK)),
    })
    return rows.drop("_numbers", "_prompt", "_target", "_all")


def decode(tokens: Column, vocab: DataFrame) -> Column:
    """The characters of predicted numbers up to the end; special symbols and features are left out. vocab: small, read once."""
    names = F.create_map(*[F.lit(x) for r in vocab.where(f"symbol_id >= {len(SPECIALS)} and length(symbol) = 1").collect() for x in (r["symbol_id"], r["symbol"])])
    end = F.array_position(tokens, EOS)
    shown = F.when(end > 0, F.slice(tokens, F.lit(1), (end - 1).cast("int"))).otherwise(tokens)
    return F.array_join(F.array_compact(F.transform(shown, lambda i: names[i])), "")
