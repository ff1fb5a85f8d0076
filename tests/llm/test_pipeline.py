"""The pipeline beside plain Python on a small corpus, and on tables with nothing in them."""

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from seriesforge.llm import queries, tokens
from tests.llm.common import frame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LENGTH, END = 2048, 1


def prose(rng, n=60):
    """Words that do not repeat, so that no rule against repetition speaks."""
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(4, 9))) for _ in range(n)) + "."


def corpus():
    rng = random.Random(17)
    texts = {i: prose(rng) for i in range(30)}
    kept = dict(texts)
    rows = list(texts.items())
    rows += [(100 + i, texts[3]) for i in range(5)] + [rows[6], rows[6]]  # copies, and rows that repeat
    for i in (4, 5):
        words = texts[i].split()
        words[30] = "changed"
        rows.append((110 + i, " ".join(words)))  # five of 56 shingles differ
    rows += [(200, None), (201, ""), (202, "far too short"), (203, " ".join(["again and again"] * 40))]
    for i, (found, shown) in enumerate([("bob@host.org", "<EMAIL>"), ("+1 (555) 555-1234", "<PHONE>"), ("4111 1111 1111 1111", "<CARD>"), ("10.20.30.40", "<IP>")]):
        rows.append((300 + i, prose(rng).replace(".", f" {found} end.")))
        kept[300 + i] = rows[-1][1].replace(found, shown)
    rows.append((400, prose(rng, 5000)))  # longer than a sequence
    kept[400] = rows[-1][1]
    rows.append((None, prose(rng)))
    kept[None] = rows[-1][1]
    rng.shuffle(rows)
    return rows, kept


def stored(spark, folder, rows):
    table = frame(spark, [(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA)
    table.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, kept = corpus()
    got = corpus_pipeline.run(spark, stored(spark, tmp_path, rows)).collect()
    library = tokens.Library(tokens.file_text(public_tokenizers.path("word_bpe_49k.json"))).tokenizer
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == kept.keys()
    for i, text in kept.items():
        ids = library.encode(text, add_special_tokens=False).ids + [END]
        end = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == end and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            end += r.length
        assert end == len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= LENGTH


def test_stages_keep_columns(spark, tmp_path):
    rows, _ = corpus()
    folder = stored(spark, tmp_path, rows[:12])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")] and {r.extra for r in docs.collect()} == {"x"}, name


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, "")]])
def test_nothing_to_keep(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, rows)).count() == 0


@pytest.mark.parametrize("name", ["op2_cross_entropy", "op4_near_join"])
def test_shuffles_give_what_broadcasts_give(spark, monkeypatch, name):
    """The way beyond the size of a broadcast, which small tables do not take by themselves."""
    run = lambda: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in queries.queries()[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    sent = run()
    monkeypatch.setattr(queries.near, "BROADCAST_IDS", 0)
    assert run() == sent and len(sent) >= 200
