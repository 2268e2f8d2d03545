"""Encoding, packing and personal information."""

import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.llm import tokens as tokens_module
from folioweave.llm.packing import Packer, fill_report, pack, parts
from folioweave.llm.pii import _row, choose, expectation_maximisation, find_personal, fit, propose, redact, redact_personal, train
from folioweave.llm.pii_rules import LABELERS, Finder, feature
from folioweave.llm.tokens import TOKENIZERS, TokenBytes, decode_corpus, encode_corpus, ranks, token_counts, word_encoder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world, it's  fine.\r\n", "<|endoftext|> is text", "日本語 and 🎉🎉 naïve", "don't we'll THEY'RE", "a" * 20_000,
    "word " * 5_000, " " * 3_000 + "x", "1234567 ٣٤٥ ½", " ​ x", "שלום مرحبا", "Hello world, it's  fine.\r\n",
]


def encoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return {r.doc_id: r.ids for r in encode_corpus(df).collect()}


@pytest.mark.parametrize("block", [1, 100, 1_000_000])
def test_ids_as_the_tokenizer_gives(spark, reference, monkeypatch, block):
    monkeypatch.setattr(tokens_module, "BLOCK_CHARS", block)
    assert encoded(spark, TEXTS) == {i: reference(t) if t else [] for i, t in enumerate(TEXTS)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=20, max_size=60))
def test_ids_of_any_text(spark, reference, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(spark, texts) == {i: reference(t) if t else [] for i, t in enumerate(texts)}


def test_round_trip_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], "doc_id BIGINT, text STRING").withColumn("key", F.lit(1))
    assert sorted((r.doc_id is None, len(r.ids)) for r in encode_corpus(rows).collect()) == [(False, 1), (True, 2), (True, 2)]
    assert encode_corpus(df.limit(0)).count() == 0
    counts = df.select("doc_id", token_counts(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in counts} == {i: len(ids) for i, ids in encoded(spark, TEXTS).items()}


def test_decoding_of_repeated_null_unknown_and_cut_off_ids(spark):
    encode = word_encoder().encode_ordinary
    half = [i for i in encode("\U0001f389") if i][:1]  # a part of a character's bytes
    rows = [(1, encode("a b")), (1, encode("c")), (None, encode("d")), (2, half), (3, [10**6]), (4, None), (5, []), (6, [*encode("x"), None, -1])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, ids ARRAY<INT>").withColumn("text", F.lit("mine"))
    got = sorted((str(r.doc_id), r.text) for r in decode_corpus(df).collect())
    assert got == sorted([("1", "a b"), ("1", "c"), ("None", "d"), ("2", "\ufffd"), ("3", "\ufffd"), ("4", ""), ("5", ""), ("6", "x\ufffd\ufffd")])
    assert decode_corpus(df.limit(0)).count() == 0


def test_decoding_takes_linear_time():
    table = TokenBytes(ranks())
    ids = np.arange(40_000) % 50_000
    began = time.perf_counter()
    table.texts(np.tile(ids, 25), np.array([0, 1_000_000]))
    assert time.perf_counter() - began < 5


def test_documents_out_of_a_shuffle(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id BIGINT, text STRING").repartition(3)
    assert {r.doc_id: r.ids for r in encode_corpus(df).collect()} == {i: reference(t) if t else [] for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("group", [1, 2])
def test_groups_of_partitions(spark, reference, monkeypatch, group):
    monkeypatch.setattr(tokens_module, "GROUP_PARTITIONS", group)
    assert encoded(spark, TEXTS) == {i: reference(t) if t else [] for i, t in enumerate(TEXTS)}


def test_encode_words_once():
    encode = word_encoder().encode_ordinary
    assert encode(" the") == encode(" the") and len(encode("x" * 100_000)) > 1


# --- packing ---------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 25), max_size=200), st.integers(1, 8))
def test_packer_is_best_fit_in_bounded_space(sizes, open_bins):
    """Against a plain list of open bins."""
    packer, spaces, n_bins = Packer(10, open_bins), {}, 0
    for size in (p for s in sizes for p in parts(s, 10)):
        number = packer.put(size)
        fitting = [f for f in spaces.values() if f >= size]
        if fitting:
            assert spaces[number] == min(fitting)
        else:
            assert number == n_bins
            n_bins += 1
            if len(spaces) >= open_bins:
                least = min(spaces.values())
                closed = [k for k, f in spaces.items() if f == least]
                open_now = {k for found in packer.bins.values() for k in found}
                (gone,) = [k for k in closed if k not in open_now]
                del spaces[gone]
            spaces[number] = 10
        spaces[number] -= size
        assert spaces[number] >= 0 and len(spaces) <= open_bins


def test_parts():
    assert parts(0, 5) == [0] and parts(5, 5) == [5] and parts(11, 5) == [5, 5, 1] and parts(10, 5) == [5, 5]


def test_pack(spark):
    rng = random.Random(1)
    sizes = [rng.randint(0, 700) for _ in range(500)] + [0, 5000, 1024]
    df = spark.createDataFrame(list(enumerate(sizes)), "item_id BIGINT, size BIGINT").repartition(3)
    capacities = {"small": 512, "large": 2048}
    packed = pack(df, capacities)
    for name, capacity in capacities.items():
        rows = [r for r in packed.collect() if r.size_name == name]
        whole = {}
        for r in rows:
            whole.setdefault(r.item_id, []).append((r.part_no, r.n_units))
        assert {i: sum(n for _, n in ps) for i, ps in whole.items()} == dict(enumerate(sizes))
        assert all(len(ps) == 1 or sizes[i] > capacity for i, ps in whole.items())
        assert all([no for no, _ in sorted(ps)] == list(range(len(ps))) for ps in whole.values())
    report = {r.size_name: r for r in fill_report(packed, capacities).collect()}
    assert all(r.max_units <= capacities[n] and r.fill > 0.9 for n, r in report.items())


def test_pack_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, 3), (None, 3), (1, None), (2, -4)], "item_id BIGINT, size INT").withColumn("pack_id", F.lit("x"))
    assert sorted(r.n_units for r in pack(df, {"a": 5}).collect()) == [0, 0, 3, 3]
    assert pack(df.limit(0), {"a": 5}).count() == 0 and pack(df, {}).count() == 0
    with pytest.raises(ValueError, match="positive"):
        pack(df, {"a": 0})


# --- personal information --------------------------------------------------------

GIVEN, FAMILY = ["Halvar", "Zoë", "Page", "Tavira"], ["Fisk", "O'Tarrin", "Judge", "Denholm"]
CASES = [
    ("Please send it to halvar.fisk@mail.tarnlaw.example.", [("email", "halvar.fisk@mail.tarnlaw.example")]),
    ("cc: zoe-f [at] x7 [dot] norvane [dot] test", [("email", "zoe-f [at] x7 [dot] norvane [dot] test")]),
    ("Write to amy dot o5 at post dot selwick dot test if needed", [("email", "amy dot o5 at post dot selwick dot test")]),
    ("mailto:A+B@C.EXAMPLE", [("email", "A+B@C.EXAMPLE")]),
    ("Set margin @ 1.25in, gutter @ 0.81in. Build 0.1 @ commit 7e00e4d passed.", []),
    ("call me on (608) 555-0101 after lunch", [("phone", "(608) 555-0101")]),
    ("Tel. +44\n20 7946 0418\nThe town", [("phone", "+44\n20 7946 0418")]),
    ("Joignable au +33 (0)1 99 00 44 55.", [("phone", "+33 (0)1 99 00 44 55")]),
    ("Fax and voice: 608-555-0101, ext. 4", [("phone", "608-555-0101")]),
    ("Transcript index 608-555-0308 marks the sidebar.", []),
    ("Redact SSN: 912-45-8976 before the appendix is filed.", [("id_number", "912-45-8976")]),
    ("noch Steuer-ID 08\n318 347 012.", [("id_number", "08\n318 347 012")]),
    ("See Exhibit 482-72-5811. Batch 964587603 held. Parcel No. 910-79-7107 lies.", []),
    ("The number was already masked as ***-**-5281.", []),
    ("The premises at 7293 SW Nettle Hill Street, Apt. 2B\nTarn Hollow, QL 00178-1234 were vacant.", [("address", "7293 SW Nettle Hill Street, Apt. 2B\nTarn Hollow, QL 00178-1234")]),
    ("resides at P. O. Box 44, Lornstead, WX 00161.", [("address", "P. O. Box 44, Lornstead, WX 00161")]),
    ("Die Zeugin wohnt Am Krähenbusch 59 c, 00802 Brunstedt.", [("address", "Am Krähenbusch 59 c, 00802 Brunstedt")]),
    ("Le témoin demeure 75 ter, rue des Tilleuls-Gris, 00366 Orsel-sur-Tarn.", [("address", "75 ter, rue des Tilleuls-Gris, 00366 Orsel-sur-Tarn")]),
    ("Domicilio: Plaza San Orsel, 10, 2.º B, 00335 Torrequil", [("address", "Plaza San Orsel, 10, 2.º B, 00335 Torrequil")]),
    ("Route 15 meets the Larkmoor Avenue corridor. 12 Windrow findings were left.", []),
    ("Prepared by: Halvar E. Fisk\nThe rest", [("person_name", "Halvar E. Fisk")]),
    ("FISK, HALVAR testified that it was complete.", [("person_name", "FISK, HALVAR")]),
    ("Mrs O'Tarrin's lease ran on.", [("person_name", "O'Tarrin")]),
    ("Mr. Judge objected. Judge and jury heard it.", [("person_name", "Judge")]),
    ("The panel questioned Tavira\nvan der Fisk about the gap.", [("person_name", "Tavira\nvan der Fisk")]),
    ("hi, this is zoë denholm, the plugin fails", [("person_name", "zoë denholm")]),
    ("Will the court rule? Mark the page and hope. See Page Harbor Authority, 3 Vex. 2d 1.", []),
    ("Witness list: Halvar Fisk; Zoë Denholm; the surveyor", [("person_name", "Halvar Fisk"), ("person_name", "Zoë Denholm")]),
]


@pytest.fixture(scope="module")
def names(spark):
    rows = [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given"), ("x", None)]
    return spark.createDataFrame(rows, "name_part STRING, part_kind STRING")


def corpus(spark):
    """The cases, often enough for the estimates, and rows without anything to find."""
    rows = [(i, t) for i, (t, _) in enumerate(CASES * 5)] + [(-1, None), (-2, ""), (-3, " \n"), (-4, "a" * 200_000), (None, CASES[0][0])]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("spans", F.lit(1))


@pytest.fixture(scope="module")
def personal(spark, names):
    found = {}
    for r in find_personal(corpus(spark), names).orderBy("start").collect():
        found.setdefault(r.doc_id, []).append((r.pii_type, r.pii_text))
    return found


@pytest.mark.parametrize("case", range(len(CASES)))
def test_found(personal, case):
    assert personal.get(case, []) == CASES[case][1]


def test_found_elsewhere(personal):
    assert personal[None] == CASES[0][1] and all(i not in personal for i in (-1, -2, -3, -4))


def test_redacted(spark, names):
    docs = corpus(spark)
    rows = {r.doc_id: r for r in redact(docs, names, fit(propose(docs, names))).collect()}
    assert len(rows) == docs.count()
    assert (rows[-1].text, rows[-2].text, rows[-3].text, len(rows[-4].text)) == (None, "", " \n", 200_000)
    assert rows[0].text == "Please send it to [EMAIL]." and rows[0].n_replaced == 1
    assert rows[8].text == "Fax and voice: [PHONE], ext. 4"
    assert rows[27].text == "Witness list: [PERSON_NAME]; [PERSON_NAME]; the surveyor"
    assert {r.doc_id: r for r in redact_personal(docs, names).collect()} == rows


def test_no_documents(spark, names):
    empty = corpus(spark).limit(0)
    assert find_personal(empty, names).count() == 0 and find_personal(corpus(spark).filter("doc_id < 0"), names.limit(0)).count() == 0


def test_long_texts_take_linear_time():
    finder = Finder({"halvar"}, {"fisk"})
    for text in ("a" * 300_000, "A. " * 50_000, "1 " * 100_000, "Halvar " * 30_000, "x dot " * 30_000, "1" * 300_000, "a-" * 100_000, "A B C D " * 20_000, "\n" * 200_000):
        finder.candidates(text)


def proposed(text, pii_type):
    return {text[c.start : c.end] for c in Finder({"halvar"}, {"fisk", "kettlethorn", "ferry"}).candidates(text) if c.pii_type == pii_type}


@pytest.mark.parametrize(
    "label, number",
    [
        ("Passport ", "C01X00T47"), ("passeport n°", "12AB34567"), ("driving licence ", "MORGA657054SM9IJ"), ("passport ", "123456ABCDEF"), ("DL No.: ", "A1 B2 C3 D4"),
        ("NIR ", "1 85 05 2A 123 456 78"), ("SSN: ", "912\u202f45\u202f8976"), ("SSN: ", "912-45-8976"),
    ],
)
def test_labelled_numbers_are_proposed_whole(label, number):
    assert number in proposed(f"The {label}{number} was read out.", "id_number")
    assert proposed(f"Exhibit {number} of C01X00T47, A1B2C3D4E5", "id_number") <= {number}


def test_names_of_known_families_are_proposed():
    assert "Zorvik Kettlethorn" in proposed("Then Zorvik Kettlethorn left the hall", "person_name")
    told = {"Zorvik Unheard": -1, "Zorvik Kettlethorn": 1, "Pelham Ferry": -1}  # an ordinary word tells nothing
    text = "Then Zorvik Unheard and Zorvik Kettlethorn left the Pelham Ferry"
    assert {n: votes_of(text, n)["family_known"] for n in told} == told


def test_candidates_are_generous_and_labelers_differ():
    text = "Yesterday Ada Quill rang (020) 7946 0958, exhibit 912-45-8976, about 221B Baker Street, London NW1 6XE."
    found = {(c.pii_type, text[c.start : c.end]) for c in Finder(set(), set()).candidates(text)}
    assert found >= {("person_name", "Ada Quill"), ("phone", "(020) 7946 0958"), ("id_number", "912-45-8976"), ("address", "221B Baker Street, London NW1 6XE")}
    for pii_type, names in LABELERS.items():
        votes = np.array([c.votes for t, _ in CASES for c in Finder({"halvar", "zoë"}, {"fisk", "denholm"}).candidates(t) if c.pii_type == pii_type])
        for i, j in itertools.combinations(range(len(names)), 2):
            same = len({tuple(v) for v in votes[:, [i, j]]}) <= max(len(set(votes[:, i])), len(set(votes[:, j])))
            assert not same or len(set(votes[:, i])) == 1 or len(set(votes[:, j])) == 1 or len(votes) < 20, (pii_type, names[i], names[j])


def votes_of(text, span, finder=None):
    finder = finder or Finder({"halvar"}, {"fisk", "kettlethorn", "ferry"})
    (c,) = [c for c in finder.candidates(text) if text[c.start : c.end] == span]
    return dict(zip(LABELERS[c.pii_type], c.votes, strict=True))


def test_labelled_local_phones_are_proposed():
    assert proposed("Phone: 555-0142, ask for the clerk", "phone") == {"555-0142"}
    assert proposed("Tel. 0911 4567", "phone") == {"0911 4567"}
    assert proposed("Phone: 555-0142 12 Elm Street", "phone") == {"555-0142"}
    text = "Exhibit 555-0142, 0911 4567; call 12"
    assert proposed(text, "phone") == {"555-0142", "0911 4567"}
    assert votes_of(text, "555-0142")["other_label"] == 0 and votes_of(text, "0911 4567")["cue_before"] == -1


@pytest.mark.parametrize(
    "address",
    ["17 rue des Lilas, 17000 La Rochelle", "Calle Mayor 5, 28700 San Sebastián de los Reyes", "Am Krähenbusch 59 c, 60311 Frankfurt am Main", "3 quai Nord, 13200 Saint-Martin de l'Isle", "4 rue Basse, 00366 Orsel-sur-Tarn"],
)
@pytest.mark.parametrize("after", [" und blieb.", "\nThe Rest", ", Then", " Tel. 0911 4567", " Email: x"])
def test_towns_of_several_words(address, after):
    assert proposed(address + after, "address") == {address}


def test_titles_after_slashes_dashes_and_at_signs():
    assert proposed("Herr/Frau Müller kam", "person_name") == {"Müller"}
    assert proposed("Mr./Mrs. Smith came", "person_name") == {"Smith"}
    assert proposed("done\n--Dr. Jones", "person_name") == {"Jones"}
    assert proposed("to @Prof. Braun, Jean-Halvar Fisk/Halvar Fisk", "person_name") - {"Braun, Jean-Halvar"} == {"Braun", "Jean-Halvar Fisk"}


FIRST = "Orla Bevin Tamsin Corin Jory Lowen Merryn Piran Wenna Talan Elowen Kensa Myghal Sowena Jenna Ruan Tegen Cador Demelza Hedrek".split()
LAST = "Angwin Bolitho Carne Dancey Edgcumbe Fenwith Gundry Hocking Ivey Jago Kitto Lanyon Menear Nance Opie Penrose Quiller Rosewarne Sandry Tregear".split()
PLACES = [f"{a} {b}" for a in "North South Upper Lower Great".split() for b in "Quay Moor Landing Pier Gate".split()]


def fitted_on(spark, texts, names):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return fit(propose(docs, names))


def test_the_classifier_finds_what_no_vote_tells(spark):
    """Names that no list has, in wordings that no cue has: held out, the votes find none of them."""
    rng = random.Random(8)
    wording = ["the keeper {} locked the shed", "a parcel for {} came late", "we saw {} on the stairs", "minutes taken by clerk {} again"]
    places = ["the road to {} is shut", "fog over {} all day", "ferries from {} run late"]
    texts = [rng.choice(wording).format(f"{rng.choice(FIRST)} {rng.choice(LAST)}") for _ in range(600)]
    texts += [rng.choice(places).format(rng.choice(PLACES)) for _ in range(600)] + [t for t, _ in CASES * 5]
    names = spark.createDataFrame([(n, "given") for n in FIRST] + [(n, "family") for n in LAST], "name_part STRING, part_kind STRING")
    model = fitted_on(spark, texts, names)
    finder = Finder({n.lower() for n in FIRST}, {n.lower() for n in LAST})
    unknown = [f"{a}{b} {c}{d}" for a, b, c, d in zip(["Zel", "Mor", "Vik", "Tab", "Ner"] * 8, ["ora", "eth", "in", "ara"] * 10, ["Hax", "Brun", "Osk", "Dorn", "Wyl"] * 8, ["ley", "mont", "ers", "wick"] * 10, strict=True)]
    held_out = [(w.format(n), n) for n in unknown for w in wording]
    by_votes = by_both = wrong = 0
    for text, name in held_out:
        spans = [_row(text, c) for c in finder.candidates(text)]
        by_votes += any(s["pii_text"] == name and model.vote_odds(s["pii_type"], s["votes"]) > 0 for s in spans)
        by_both += [s["pii_text"] for s in choose(spans, model)] == [name]
    for text in (w.format(f"{a} {b}") for w in places for a in ["Outer", "Old", "High"] for b in ["Wharf", "Bridge", "Common"]):
        wrong += len(choose([_row(text, c) for c in finder.candidates(text)], model))
    assert by_votes == 0 and by_both >= 0.9 * len(held_out) and wrong <= 2


OTHER_WORDING = [
    ("I met with Orla Carne yesterday and later thanked Piran Jago.", ["Orla Carne", "Piran Jago"]),
    ("According to Tegen Opie, the bridge was closed.", ["Tegen Opie"]),
    ("Contact: Ruan Sandry, tel 030 1234567", ["Ruan Sandry", "030 1234567"]),
    ("Kontakt: +43 1 5128900", ["+43 1 5128900"]),
    ("Ring me on (020) 7946 0958.", ["(020) 7946 0958"]),
    ("He lived at 221B Baker Street, London NW1 6XE.", ["221B Baker Street, London NW1 6XE"]),
    ("She lives at 12 Oak Street in Springfield.", ["12 Oak Street in Springfield"]),
    ("My social is 123-45-6789.", ["123-45-6789"]),
    ("Please reach me at jane.doe@corp.example or call 415-555-0199.", ["jane.doe@corp.example", "415-555-0199"]),
    ("Her driver's license is S530-4600-7800-12.", ["S530-4600-7800-12"]),
    ("Ich heiße Klaus Fischer und wohne Lindenstraße 5, 10969 Berlin.", ["Klaus Fischer", "Lindenstraße 5, 10969 Berlin"]),
    ("Me llamo Lucía Fernández.", ["Lucía Fernández"]),
    ("Le docteur est M. Dubois.", ["Dubois"]),
    ("The Grand Canyon is large. New York is a city. Article 555-0142 was sold.", []),
    ("Mail the form to 45 Elm Avenue, Denver, CO 80203.", ["45 Elm Avenue, Denver, CO 80203"]),
]


def test_recall_on_other_wording(spark, names):
    docs = corpus(spark)
    model = fit(propose(docs, names))
    finder = Finder({n.lower() for n in GIVEN} | {"orla", "piran", "tegen", "ruan"}, {n.lower() for n in FAMILY})
    found = [([s["pii_text"] for s in choose([_row(t, c) for c in finder.candidates(t)], model)], spans) for t, spans in OTHER_WORDING]
    hits, total = sum(len(set(got) & set(spans)) for got, spans in found), sum(len(spans) for _, spans in found)
    wrong = sum(len(set(got) - set(spans)) for got, spans in found)
    assert hits >= 0.9 * total and wrong <= 1, [x for x in found if x[0] != x[1]]


def test_sample_of_spans_is_bounded(spark, names):
    proposed = propose(corpus(spark), names)
    few = fit(proposed, sample_spans=5)
    assert few.prior.keys() == fit(proposed).prior.keys() and np.count_nonzero(few.weights) < np.count_nonzero(fit(proposed).weights)


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in (0.95, 0.9, 0.7)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    theta, prior, q = expectation_maximisation(patterns, counts.astype(float))
    assert 0.3 < prior < 0.5 and theta[0, 1, 2] > theta[2, 1, 2]
    likely = dict(zip(map(tuple, patterns), q, strict=True))
    assert np.mean([(likely[tuple(v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.9


def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(6)
    rows = [[feature(f"w{w}") for w in rng.choice(200, 6, replace=False)] for _ in range(3000)]
    weight = {feature(f"w{w}"): rng.normal() for w in range(200)}
    labels = np.array([float(sum(weight[f] for f in r) > 0) for r in rows])
    weights = train(rows[:2000], labels[:2000])
    assert np.mean([(weights[r].sum() > 0) == (y > 0.5) for r, y in zip(rows[2000:], labels[2000:], strict=True)]) > 0.85
