import random

from brute import GPT2, split_specials
from pyspark.sql import functions as F

from lexmill.functions import text as T

ALPHABET = (
    [*"ab Z09'sdlvetmr.,!?-_<|>\n\t\r"]
    + [" ", " ", "　", "\x0b", "\x1c", "\x85", "é", "ß", "ñ", "漢", "字", "ｱ", "Ⅷ", "½", "٣"]
    + ["́", "😀", "‍", "\U0001e030", "\U00031350", "\U00011f50", "ࡰ", "𝟘", "ᾳ"]
)


def random_texts(n, seed, alphabet=ALPHABET):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(n)]


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [row.out for row in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_pretokens_equal_the_regex_module(spark):
    texts = random_texts(3000, 1)
    assert apply(spark, texts, T.pretokens(F.col("text"))) == [GPT2.findall(t) for t in texts]


def test_pretokens_of_every_letter_and_number(spark):
    texts = []
    for start in range(0, 0x110000, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        texts.append("".join(chars))
    assert apply(spark, texts, T.pretokens(F.col("text"))) == [GPT2.findall(t) for t in texts]


def test_strip(spark):
    texts = random_texts(2000, 2)
    assert apply(spark, texts, T.strip(F.col("text"))) == [t.strip() for t in texts]


def test_newlines(spark):
    texts = ["a\r\nb\rc\n", "\r", "\r\n\r\n", "\r\r\n\n", ""]
    expected = ["a\nb\nc\n", "\n", "\n\n", "\n\n\n", ""]
    assert apply(spark, texts, T.normalize_newlines(F.col("text"))) == expected


def test_segments_prefer_longer_specials(spark):
    specials = ["<|e|>", "<|e|><|e|>", "b", "ab."]
    texts = random_texts(2000, 3, ["<|e|>", "a", "b", ".", " ", "<|", "|>"])
    found = apply(spark, texts, T.segments(F.col("text"), specials))
    for text, parts in zip(texts, found):
        assert [(p.is_special, p.text) for p in parts] == split_specials(text, specials)
        assert [p.seg for p in parts] == list(range(len(parts)))


def test_training_keeps_the_order_of_specials(spark):
    texts = ["x<|e|><|e|>y", "<|e|>"]
    short_first = T.plain_parts(F.col("text"), ["<|e|>", "<|e|><|e|>"], longest_first=False)
    assert apply(spark, texts, short_first) == [["x", "", "y"], ["", ""]]


def test_symbols_sort_like_bytes(spark):
    rnd = random.Random(4)
    words = list({"".join(rnd.choices("abé ", k=rnd.randint(1, 4))) for _ in range(200)})
    found = apply(spark, words, T.symbols(F.col("text")))
    assert [w for _, w in sorted(zip(found, words))] == sorted(words, key=str.encode)
    assert found[0] == "".join(f"({b:02X})" for b in words[0].encode())
