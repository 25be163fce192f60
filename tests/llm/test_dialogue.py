from pyspark.sql import functions as F

from newsloom.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, place long, part string"


def brute(turns, size):
    talks = {}
    for conv, turn, role, text in turns:
        who = (role or "").strip(" ") or "unknown"
        talks.setdefault(conv, []).append((turn is not None, turn or 0, who, text or ""))
    out = []
    for conv, said in talks.items():
        said.sort()
        for me in {s for _, _, s, _ in said} - {"system"}:
            for part in range(0, len(said), size):
                text, mask, trained = "", [], 0
                for _, _, who, content in said[part : part + size]:
                    name = "assistant" if who == me else "system" if who == "system" else f"user name={who}"
                    text += f"<|{name}|>\n"
                    body = content + "<|end|>\n"
                    if who == me:
                        mask.append(f"{len(text)}:{len(body)}")
                        trained += len(body)
                    text += body
                out.append((conv, me, part // size, len(said[part : part + size]), text, " ".join(mask), trained))
    return sorted(out, key=str)


def found(spark, turns, size=dialogue.PART):
    table = spark.createDataFrame([(*t, 5, "x") for t in turns], SCHEMA).repartition(3)
    return sorted(map(tuple, dialogue.rotate(table, part=size).collect()), key=str)


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 4, "cy", "x" * 3000),
    (2, 0, "system", "alone"), (3, None, None, "who"), (3, 1, " ", "again"), (3, 1, "ann", "tie"), (3, 1, "ann", "tie"),
    (None, 1, "ann", "no id"), (None, None, "bob", "first"),
]


def test_every_participant_is_once_the_assistant(spark):
    assert found(spark, TURNS) == brute(TURNS, dialogue.PART)


def test_long_conversations_come_in_parts(spark):
    turns = [(1, i, ["ann", "bob", "system"][i % 3], f"turn {i}") for i in range(50)] + [(2, 1, "ann", "x")] * 9
    assert found(spark, turns, 4) == brute(turns, 4)


def test_masks_cover_what_the_assistant_says(spark):
    for _, _, _, _, text, mask, trained in found(spark, TURNS):
        spans = [tuple(map(int, m.split(":"))) for m in mask.split()]
        assert sum(n for _, n in spans) == trained
        for start, length in spans:
            assert text[:start].endswith("<|assistant|>\n") and text[start : start + length].endswith("<|end|>\n")


def test_empty_table_and_native_plan(spark):
    assert found(spark, []) == []
    table = spark.createDataFrame([(*t, 5, "x") for t in TURNS], SCHEMA)
    plan = dialogue.rotate(table).filter(F.col("n_turns") > 0)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
