import random

import pytest

from marginwise.llm import secrets


@pytest.mark.parametrize(
    "make",
    [
        lambda draw: "k." + "".join(draw.choices("0123456789", k=7)),
        lambda draw: "".join(draw.choices("0123456789", k=4)) + "".join(draw.choices("GHIJKLMN", k=4)),
        lambda draw: "".join(draw.choices("GHIJKLMNOPQRSTUVWXYZ", k=18)),
    ],
    ids=["dotted", "short", "letters"],
)
def test_short_dotted_and_letter_only_formats_are_scored(spark, make):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(6, 12))) for _ in range(400)]
    rows = [(k, f"{' '.join(draw.choices(words, k=12))} token={make(draw)}") for k in range(200)]
    key = make(draw)
    rows.append((500, f"{' '.join(words[:12])} {key} {' '.join(words[12:24])}"))
    found = {r["doc_id"]: r["secrets"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    text = rows[-1][1]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in found[500]] == [("format", key)]
    assert sum(len(v) for v in found.values()) == 201
