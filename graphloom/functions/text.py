"""Scalar text functions as column expressions."""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schemas
from graphloom.session import ship

#: ASCII punctuation (fixed value).
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
#: Letters that decomposition does not reduce to ASCII, and the Cyrillic ones (fixed values).
PLAIN = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "ð": "d",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
}
def _bare_letters() -> dict[str, str]:
    """Letters with marks, and other forms of one ASCII character, by compatibility decomposition."""
    blocks = (0x00C0, 0x0250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F)
    pairs = ((chr(i), "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))) for low, high in blocks for i in range(low, high))
    return {letter: bare for letter, bare in pairs if len(bare) == 1 and bare.isascii()}


BARE = _bare_letters()


def ascii_letters(text: Column) -> Column:
    """Transliteration to ASCII for Latin letters with marks, full-width forms and Cyrillic; stays in the JVM."""
    out = F.translate(F.regexp_replace(text, r"\p{M}+", ""), "".join(BARE), "".join(BARE.values()))
    for letter, plain in PLAIN.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
        if letter.upper() != letter and letter.upper() not in PLAIN and len(letter.upper()) == 1:
            out = F.replace(out, F.lit(letter.upper()), F.lit(plain.capitalize()))
    return out


def normalize(text: Column, transliterate: bool = True) -> Column:
    """Answers as they are compared: plain, lower-case, no commas or dots within numbers, punctuation as space, single spaces."""
    out = F.lower(ascii_letters(text) if transliterate else text)
    out = F.regexp_replace(out, r"(?<=\d)[,.](?=\d)", "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def exact_match(answer: Column, truth: Column) -> Column:
    return (normalize(answer) == normalize(truth)).cast("int")


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 of the two bags of tokens; 0 without overlap, 1 if both are empty."""
    a, b = (F.filter(F.split(normalize(x), " "), lambda w: w != "") for x in (answer, truth))
    times = lambda bag, word: F.size(F.filter(bag, lambda x: x == word))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared / both)


def sanitize(text: Column) -> Column:
    """Trimmed, without escaped quotes; a text that begins with an escaped code point is decoded."""
    bare = F.replace(F.trim(text), F.lit('\\"'), F.lit(""))
    decoded = F.from_json(F.concat(F.lit('["'), F.replace(bare, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>")[0]
    return F.trim(F.when(bare.startswith("\\u"), F.coalesce(decoded, bare)).otherwise(bare))


def is_none_answer(text: Column) -> Column:
    """Whether only the word None is left without punctuation."""
    return F.coalesce(F.regexp_replace(text, r"(?U)[^\w\s]", "") == "None", F.lit(False))


def merge_maps(left: Column, right: Column) -> Column:
    """The entries of both maps; of a key in both the right one's."""
    kept = F.map_filter(F.coalesce(left, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(right, F.create_map().cast("map<string,string>")))


def uri_tail(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def format_qualifiers(qualifiers: Column) -> Column:
    return F.array_join(F.transform(qualifiers, lambda q: F.concat(q["relation"], F.lit(": "), q["object"])), ", ")


def verbalize(subject: str = "subject", relation: str = "relation", object_: str = "object", qualifiers: str | None = "qualifiers") -> Column:
    """``s, r, o`` and, where there are any, ``| q: v, …``."""
    fact = F.concat_ws(", ", subject, relation, object_)
    if qualifiers is None:
        return fact
    return F.when(F.coalesce(F.size(qualifiers), F.lit(0)) > 0, F.concat(fact, F.lit(" | "), format_qualifiers(F.col(qualifiers)))).otherwise(fact)


def count_tokens(text: Column) -> Column:
    """Words and single marks; the checkable stand-in for a model's tokenizer."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0))), F.lit(0))


def fenced(text: Column) -> Column:
    """The body of the first fenced block, if any."""
    return F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))


TRIPLETS_JSON = T.StructType([T.StructField("triplets", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "relation", "object")] + [T.StructField("qualifiers", schemas.QUALIFIERS)] + [T.StructField(n, T.StringType()) for n in ("subject_type", "object_type")])))])


def extract_json(text: Column) -> Column:
    """The whole text if it is JSON, else a fenced block, else the first balanced object or list amid prose, else the text itself.

    A part is balanced where it is JSON: of all parts from an opening to a closing bracket the first that parses is taken, by the place
    where it opens, then where it closes.
    """
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    none = F.lit(None).cast("string")
    # An object ends with a brace and a list with a bracket, so other parts need not be parsed; and none is once one is found.
    closed = lambda x: (x.startswith("{") & x.endswith("}")) | (x.startswith("[") & x.endswith("]"))
    head = lambda parts, i: F.array_join(F.slice(parts, 1, i), "")
    first_head = lambda parts: F.aggregate(F.sequence(F.lit(1), F.size(parts)), none, lambda got, i: F.coalesce(got, bound(head(parts, i), lambda x: F.when(closed(x), valid(x)))))
    first_tail = lambda pieces: F.aggregate(F.sequence(F.lit(1), F.size(pieces)), none, lambda got, i: F.coalesce(got, bound(F.split(F.array_join(F.slice(pieces, i, F.size(pieces)), ""), r"(?<=[}\]])"), first_head)))
    amid = bound(F.split(text, r"(?=[{\[])"), first_tail)
    return F.coalesce(valid(F.trim(text)), valid(F.trim(fenced(text))), amid, text)


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: function(x)), F.lit(0))


def parse_triplets(text: Column) -> Column:
    """The parsed extraction; null unless it is an object with a list ``triplets``."""
    checked = lambda body: bound(F.from_json(body, TRIPLETS_JSON), lambda parsed: F.when(body.startswith("{") & parsed["triplets"].isNotNull(), parsed))
    return bound(extract_json(text), checked)


def split_sentences(text: Column) -> Column:
    """Sentences by their end marks; an approximation of a trained splitter."""
    # A function of two arguments would be given the place as the second: trim would then cut off its digits.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_fixed(df: DataFrame, key: str, text: str, size: int = 4, least: int = 4) -> DataFrame:
    """(key, chunk_id from 1, chunk): ``size`` sentences each; a last chunk under ``least`` joins the one before."""
    held = df.select(key, split_sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
    full = F.greatest(F.lit(1), F.floor(F.size("s") / F.lit(size)) + F.when(F.size("s") % size >= least, 1).otherwise(0)).cast("int")
    held = held.withColumn("full", full).select(key, "s", "full", F.explode(F.sequence(F.lit(1), "full")).alias("chunk_id"))
    start = (F.col("chunk_id") - 1) * size + 1
    length = F.when(F.col("chunk_id") == F.col("full"), F.size("s")).otherwise(F.lit(size))
    return held.select(key, "chunk_id", F.array_join(F.slice("s", start, length), " ").alias("chunk"))


def chunk_sections(sections: DataFrame, size: int = 4, least: int = 4) -> DataFrame:
    """(filename, section, chunks) from (filename, section, text): each section's chunks by number, from 1."""
    keyed = sections.withColumn("_key", F.struct("filename", "section"))
    chunks = chunk_fixed(keyed, "_key", "text", size, least)
    listed = chunks.groupBy("_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk")))).alias("chunks"))
    return listed.select("_key.filename", "_key.section", "chunks")


def chunk_random(df: DataFrame, key: str, text: str, seed: int = 0) -> DataFrame:
    """Chunks of three to five sentences, their sizes drawn from key and seed, so that no run differs.

    Five sentences or fewer are taken at once, and a rest of under four joins the last chunk.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, chunks = [], [], []
            for row, (name, sentences) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                draw, at, n = random.Random(f"{seed}:{name}"), 0, 0
                while at < len(sentences or []):
                    left = len(sentences) - at
                    take = left if left <= 5 else draw.randint(3, 5)
                    take = left if left - take < 4 else take
                    n += 1
                    places.append(row)
                    numbers.append(n)
                    chunks.append(" ".join(sentences[at : at + take]))
                    at += take
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=[key, "chunk_id", "chunk"])

    held = df.select(key, split_sentences(F.col(text)).alias("s"))
    return held.mapInArrow(run, f"`{key}` {held.schema[key].dataType.simpleString()}, chunk_id int, chunk string")


#: US dollars for a million tokens in and out (fixed values).
PRICES = {
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "gpt-4.1-mini": (0.4, 1.6),
    "gpt-4.1": (2.0, 8.0),
    "Meta-llama/Llama-3.3-70B-Instruct": (0.04, 0.12),
    "qwen/qwen3-32b": (0.05, 0.2),
    "Openai/Gpt-oss-120b": (0.05, 0.2),
    "Qwen/Qwen3-32B": (0.05, 0.2),
}


def cost_by_model(usage: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """Token sums and cost by model; an unknown model costs nothing."""
    sums = usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    table = usage.sparkSession.createDataFrame([(m, a, b) for m, (a, b) in prices.items()], "model string, price_in double, price_out double")
    priced = sums.join(F.broadcast(table), "model", "left").na.fill(0.0, ["price_in", "price_out"])
    return priced.select("model", "prompt_tokens", "completion_tokens", F.round((F.col("completion_tokens") * F.col("price_out") + F.col("prompt_tokens") * F.col("price_in")) / 1e6, 9).alias("cost"))


def compression(source_tokens: Column, triplet_tokens: Column) -> dict[str, Column]:
    """Ratio and savings in per cent, 0 without source tokens."""
    some = source_tokens > 0
    return {"ratio": F.when(some, triplet_tokens / source_tokens).otherwise(F.lit(0.0)), "savings_percent": F.when(some, (1 - triplet_tokens / source_tokens) * 100).otherwise(F.lit(0.0))}
