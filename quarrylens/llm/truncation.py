"""Text cut off by field limits or broken transfers.

Every text's length is recomputed as other systems count it: characters, bytes, UTF-16 units, after escaping for HTML or
JSON, with either line end. A length that far more texts of one source share than its neighbours exposes a hidden field
limit. Then the ending is inspected: an open code block, half a character, a cut mark, half a word or half a sentence.
Whether a word is whole, and whether a sentence can end with it, is read from the whole corpus. One Arrow pass over the
texts gives lengths, endings and word counts; everything after it works on a few bytes a text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.session import cut, spread

#: A length counts as a limit if its texts exceed the mean of the lengths around it by this many deviations and texts,
#: and if at least that share of them is in excess.
DEVIATIONS, LEAST, AROUND, CLOSE, EXCESS = 4.0, 3.0, 16, 2, 0.5
#: A last word is half if it makes up less than this share of all words that begin with it; it may end a text if it does so in CAN_END of its places.
HALF_SHARE, CAN_END = 0.02, 0.02
#: An open sentence whose last word tells nothing is cut unless that share of its source's texts away from limits ends openly.
HABIT = 0.1
#: Trailing dots are meant if the word before them ends a sentence in MOSTLY of its places, or the last sentence ends STOCK of the other texts with such dots.
MOSTLY, STOCK = 0.5, 0.05
#: What lengths are counted in.
MEASURES = ["characters", "bytes", "utf16", "html", "html_quotes", "html_bytes", "json", "json_ascii", "json_bytes", "crlf", "lf", "lf_bytes"]


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, words joined by "_"; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_"), F.lit(""))


def lengths(text: str) -> list[int]:
    """The length of a text by each of ``MEASURES``: escaped for HTML or JSON, as bytes, with either line end."""
    chars, octets, ascii_ = len(text), len(text.encode("utf-8", "replace")), len(text.encode("ascii", "ignore"))
    astral = len(text.encode("utf-16-le", "replace")) // 2 - chars
    count = text.count
    feeds, pairs = count("\n"), count("\r\n")
    html = 4 * count("&") + 3 * (count("<") + count(">"))
    double = count('"')
    quotes = 5 * (double + count("'"))
    json = double + count("\\") + feeds + count("\r") + count("\t") + count("\f") + count("\b")
    return [
        chars, octets, chars + astral, chars + html, chars + html + quotes, octets + html + quotes, chars + json, chars + json + 5 * (chars - ascii_) + 6 * astral, octets + json,
        chars + feeds - pairs, chars - pairs, octets - pairs,
    ]


def text_facts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(id, source, ending, word, sentence, body, hash, sizes, counts)`` of every text that isn't null or blank, in one pass.

    ``counts`` holds the batch's words in its first row: how often each stands whole and how often before a full stop or
    line end. It is written to the shared checkpoint folder, so the texts are read once.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("text rlike '\\\\S'"))

    def number(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [ending(t) for t in texts]
            counts: Counter[str] = Counter()
            finals: Counter[str] = Counter()
            for t in texts:
                whole, ends = word_uses(t)
                counts.update(whole)
                finals.update(ends)
            first = [[{"word": w, "total": n, "final": finals[w]} for w, n in counts.items()]] + [None] * (len(texts) - 1) if texts else []
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([number(x[2]) if x[0] == "dots" else None for x in found], pa.int64()),
                    pa.array([number(t.rstrip().lower()) for t in texts], pa.int64()), pa.array([number(t) for t in texts], pa.int64()), pa.array([lengths(t) for t in texts], pa.list_(pa.int32())),
                    pa.array(first, pa.list_(pa.struct([("word", pa.string()), ("total", pa.int64()), ("final", pa.int64())]))),
                ],
                ["id", "source", "ending", "word", "sentence", "body", "hash", "sizes", "counts"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return cut(base.mapInArrow(run, f"id {kind}, source string, ending string, word string, sentence bigint, body bigint, hash bigint, sizes array<int>, counts array<struct<word:string,total:bigint,final:bigint>>"))


def limits_of(facts: DataFrame) -> DataFrame:
    sized = facts.select("source", "hash", F.posexplode("sizes").alias("m", "length")).distinct()
    counts = sized.groupBy("source", "m", "length").agg(F.count(F.lit(1)).alias("texts"))

    def mean(reach: int) -> Column:
        near = Window.partitionBy("source", "m").orderBy("length").rangeBetween(-reach, reach)
        return (F.sum("texts").over(near) - F.col("texts")) / (reach + F.least(F.lit(reach), F.col("length") - 1))  # there are no lengths below 1

    # the close neighbours as well: where texts of a kind gather around a length, no single length stands out
    counts = counts.withColumn("expected", F.greatest(mean(AROUND), mean(CLOSE)))
    high = (F.col("texts") > F.col("expected") + DEVIATIONS * F.sqrt("expected") + LEAST) & (F.col("expected") <= (1 - EXCESS) * F.col("texts"))
    return counts.where(high).select("source", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("m") + 1).alias("measure"), "m", "length", "texts", "expected")


def field_limits(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Hidden field limits as ``(source, measure, length, texts, expected)``.

    Equal texts of a source count once, so repeated rows expose nothing. Null, empty and blank texts don't count.
    """
    return limits_of(text_facts(docs, source_col, text_col, source_col)).drop("m")


#: Marks that software leaves where it cuts, and how closing lines begin.
CUT_MARK = re.compile(r"(?:[\[(<{]\s*(?:cut|truncated|trunc|snip|snipped|clipped|more|gekürzt|abgeschnitten|tronqué|truncado|cortado|continued|message truncated|output truncated|text truncated|rest omitted|\.\.\.|…)[^\])>}\n]{0,30}[\])>}]|--\s?more\s?--|\bread more|<cut>)\s*$", re.I)
CLOSER = re.compile(r"\s*(?:--|—|–|~)\s*\S|(?:thanks|thank you|thx|cheers|regards|best|greetings|merci|danke|gracias|grüße|viele grüße|saludos|cordialement|signed-off-by|reviewed-by|co-authored-by|acked-by|refs?|see|fixes|closes|ticket|issue|link|cc)\b[:,]?\s*\S", re.I)
HALF = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&(?:#\d{0,5}|#x[0-9a-fA-F]{0,4}|[a-z]{1,6})|(?<!\\)\\|<br ?/?|%[0-9A-F]?)$")
TERMINAL = ".!?。！？।؟"
ELLIPSIS = re.compile(r"(?:\.{2,}|…)$")
WORD = re.compile(r"[^\W\d_]+")
LIST_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
LINK = re.compile(r"(?:https?://|www\.)\S+$")


def complete_end(line: str) -> bool:
    """A line that ends a sentence, closes a remark in parentheses or quotes, or ends with a symbol."""
    bare = line.rstrip()
    core = bare.rstrip("\"'»«”“’`*_)]}")
    if core and core[-1] in TERMINAL:
        return True
    if bare.endswith((")", "]", "}")):
        depth, pair = 0, {")": "(", "]": "[", "}": "{"}[bare[-1]]
        for i in range(len(bare) - 1, -1, -1):
            depth += (bare[i] == bare[-1]) - (bare[i] == pair)
            if not depth:
                return i > 0 and bare[i - 1].isspace() and bare[-1] == ")"
        return False
    return bool(bare) and not bare[-1].isalnum() and ord(bare[-1]) > 0x2190 and bare[-1] not in "…�"


def ending(text: str) -> tuple[str, str, str]:
    """(class, last word in lower case, last sentence) of a text.

    Classes: blank, cut (certain), whole (certain), dots, link, closer, title, item (of a list without full stops), prose
    (no full stop). The word is empty where the last token is a number or a name in code, which may end any item.
    """
    body = text.rstrip()
    if not body:
        return "blank", "", ""
    lines = [x for x in body.split("\n")]
    last = lines[-1].strip()
    words = WORD.findall(last.rstrip("….") if ELLIPSIS.search(last) else last)
    word = words[-1].lower() if words and not re.search(r"[\d`)]$", last) else ""
    sentence = re.split(r"(?<=[.!?])\s+", last)[-1].lower()
    fences = sum(x.lstrip().startswith("```") for x in lines)
    if CUT_MARK.search(last) or HALF.search(last) and not LINK.search(last):
        return "cut", word, sentence
    if fences % 2:
        return "cut", word, sentence
    if last.startswith("```"):
        return "whole", word, sentence
    if last.startswith("|"):
        width = max((x.count("|") for x in lines[:-1] if x.lstrip().startswith("|")), default=last.count("|"))
        return ("whole" if last.endswith("|") and len(last) > 1 and last.count("|") >= width else "cut"), word, sentence
    if ELLIPSIS.search(last):
        return "dots", word, sentence
    if LINK.search(last):
        return "link", word, sentence
    if complete_end(last):
        return "whole", word, sentence
    if last.count("`") % 2 or last.endswith((",", ";", ":", "(", "[", "{", "/", "-", "_", "=", "+", "«", "“", "¿", "¡", "#", "*", "–")) or re.search(r"\((?:[^()]|\([^()]*\))*$", last):
        return "cut", word, sentence
    if len(lines) > 1 and CLOSER.match(last) and len(words) <= 6:
        return "closer", word, sentence
    others = [x.strip() for x in lines[:-1] if x.strip()]
    if LIST_ITEM.match(last):
        items = []
        for x in reversed(lines[:-1]):
            if x.strip() and not LIST_ITEM.match(x) and not x.startswith(" "):
                break
            if not x.strip() and items:
                break
            if LIST_ITEM.match(x):
                items.append(x)
        stops = sum(complete_end(x) for x in items)
        if not items or stops * 2 <= len(items):
            return "item", word, sentence
        return "prose", word, sentence
    if last.startswith("#"):
        return "title", word, sentence
    if not others and not re.search(r"[.!?](?:\s|$)", last):
        return "title", word, sentence
    tail = [x for x in others if len(x) > 20]
    if tail and not any(complete_end(x) for x in tail) and not re.search(r"[.!?]\s+\w", last):
        return "item", word, sentence
    return "prose", word, sentence


LETTERS = re.compile(r"[^\W\d_]+")
#: What may follow the last word of a sentence or line.
STOP = re.compile(r"[)\]`'\"»]*(?:\(\))?`?[.!?。！？।؟](?![.…])")
FINAL = re.compile(r"([^\W\d_]++)[)\]`'\"»]*+(?:\(\))?`?(?:[.!?…](?:\s|$)|[.!?…]{2}|[ \t\r]*+\n)")


def word_uses(text: str) -> tuple[list[str], list[str]]:
    """(words, words before a full stop or line end) in lower case.

    The last word of a text without a full stop, or before trailing dots, tells nothing and doesn't count.
    """
    low = text.lower()
    words = LETTERS.findall(low)
    if words:
        last = low.rfind(words[-1])
        tail = low[last + len(words[-1]) :]
        if not re.search(r"\d", tail) and not STOP.match(tail):
            words.pop()
            low = low[:last]
    return words, FINAL.findall(low)


def longer_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """``(word, longer)``: how often the longer words stand that begin with a word of ``words``; only its lengths are cut from each."""
    sizes = words.agg(F.collect_set(F.char_length("word")).alias("sizes"))
    starts = counts.crossJoin(F.broadcast(sizes)).select("total", "word", F.explode(F.filter("sizes", lambda n: n < F.char_length("word"))).alias("n"))
    return starts.groupBy(F.expr("substring(word, 1, n)").alias("word")).agg(F.sum("total").alias("longer"))


def truncation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, ending, at_limit, evidence, truncated)`` of every text that isn't null, empty or blank.

    A text at a limit is cut if it ends openly. Away from limits the ending needs evidence of its own: a cut mark, half a
    word, a word that ends nothing, or an open sentence in a source that has hardly any. ``evidence`` is "limit", "ending" or
    "both" for cut texts. Rows that repeat the same id, source and text count once; null sources are one source.
    """
    facts = text_facts(docs, id_col, text_col, source_col)
    rows = facts.drop("counts").where("ending <> 'blank'").distinct()
    limits = limits_of(facts).groupBy("source").agg(F.collect_set(F.concat_ws(":", "m", "length")).alias("limits"))
    mine = F.transform("sizes", lambda x, i: F.concat_ws(":", i, x))
    rows = rows.join(limits, "source", "left").withColumn("at_limit", F.coalesce(F.arrays_overlap(mine, "limits"), F.lit(False))).drop("limits", "sizes", "hash")
    # only words that end some text are looked up; the other rows stay out of the join
    asks = (F.col("word") != "") & F.col("ending").isin("title", "item", "link", "dots", "prose")
    rows = cut(rows.withColumn("asks", asks))
    looked = rows.where("asks").select("word").distinct()
    counts = facts.where("counts is not null").select(F.inline("counts")).groupBy("word").agg(F.sum("total").alias("total"), F.sum("final").alias("final"))
    counts = cut(counts)
    known = looked.join(counts.withColumnRenamed("final", "ends"), "word", "left").join(longer_words(looked, counts), "word", "left")
    none = F.lit(None).cast("bigint")
    rows = rows.where("asks").join(known, "word", "left").unionByName(rows.where("not asks").withColumns({"total": none, "ends": none, "longer": none}))
    dots = rows.where("ending = 'dots'")
    phrases = dots.groupBy("sentence").agg((F.countDistinct("body") - 1).alias("said"))
    phrases = phrases.crossJoin(F.broadcast(dots.agg((F.countDistinct("body") - 1).alias("others"))))
    stock = phrases.where((F.col("said") > 0) & (F.col("said") >= STOCK * F.col("others"))).select("sentence", F.lit(True).alias("stock"))
    rows = dots.join(stock, "sentence", "left").unionByName(rows.where("ending <> 'dots'").withColumn("stock", F.lit(None).cast("boolean")))
    habits = rows.where("not at_limit").groupBy("source").agg((F.count_if(F.col("ending") == "prose") / F.count(F.lit(1))).alias("habit"))
    rows = rows.join(habits, "source", "left")

    total, ends, longer = (F.coalesce(x, F.lit(0)) for x in ("total", "ends", "longer"))
    half_word = F.col("asks") & ((total == 0) | (total < HALF_SHARE * (total + longer)))
    open_word = half_word | (F.col("asks") & (ends < CAN_END * total))
    kind, limit = F.col("ending"), F.col("at_limit")
    own = (
        F.when(kind == "cut", True)
        .when(kind == "dots", F.col("stock").isNull() & ((F.col("word") == "") | half_word | (ends < MOSTLY * total)))
        .when(kind.isin("title", "item"), open_word)
        .when(kind == "prose", open_word | (~limit & (F.col("habit") < HABIT)))
        .otherwise(False)
    )
    at = limit & (kind.isin("prose", "item", "cut") | (kind.isin("link", "title") & half_word))
    evidence = F.when(own & limit, "both").when(own, "ending").when(at, "limit")
    return rows.select("id", "source", "ending", "at_limit", evidence.alias("evidence"), evidence.isNotNull().alias("truncated"))


def truncated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Ids of the documents whose text was cut off, each once."""
    return truncation(docs, id_col, text_col, source_col).where("truncated").select(F.col("id").alias(id_col)).distinct()


def truncation_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: texts, truncated texts by evidence, their rate and the texts that stand exactly at a field limit."""
    out = truncation(docs, id_col, text_col, source_col).groupBy("source")
    out = out.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.sum(F.col("at_limit").cast("bigint")).alias("at_limit"), *[F.count_if(F.col("evidence") == x).alias(f"by_{x}") for x in ("limit", "ending", "both")])
    return out.withColumn("rate", F.col("truncated") / F.col("texts"))
