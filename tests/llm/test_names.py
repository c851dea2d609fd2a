from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm import names as N

PERSONS = {
    "Jonathan Brudoskem": ("jonathan", "brudoskem"), "BRUDOSKEM, Jonathan": ("jonathan", "brudoskem"), "BRUDOSKEM Jonathan": ("jonathan", "brudoskem"), "Dr. Jonathan Brudoskem": ("jonathan", "brudoskem"),
    "Jonathan Brudoskem, PhD": ("jonathan", "brudoskem"), "Jonathan M. Brudoskem BSc PhD": ("jonathan", "brudoskem"), "Jonathan Brudoskem (PI)": ("jonathan", "brudoskem"), "Brudoskem J": ("j", "brudoskem"), "Brudoskem JM": ("j", "brudoskem"),
    "J. M. Brudoskem": ("j", "brudoskem"), "J.M. Brudoskem": ("j", "brudoskem"), "Brudoskem, J.": ("j", "brudoskem"), "Brudoskem MS": ("m", "brudoskem"), "jonathan brúdoskem": ("jonathan", "brudoskem"), "Prof. Dr J. Brudoskem": ("j", "brudoskem"), "": None, "123": None,
}
ORGANISATIONS = {
    "University of Bramstad": ("university", "bramstad"), "The University of Bramstad, School of Medicine": ("university", "bramstad"), "Bramstad Univ.": ("university", "bramstad"), "U. of Bramstad": ("university", "bramstad"), "@univ-bramstad": ("university", "bramstad"),
    "Dept. of Epidemiology, University of Bramstad": ("university", "bramstad"), "General Hospital, Bramstad": ("hospital", "bramstad"), "Bramstad Gen. Hosp.": ("hospital", "bramstad"), "Cardiology, Bramstad General Hospital": ("hospital", "bramstad"),
    "BramstadGenomics": ("genomics", "bramstad"), "Bramstad Genomics, Ltd.": ("genomics", "bramstad"), "@bramstad-genomics": ("genomics", "bramstad"), "Inst. Public Health Bramstad": ("institute", "bramstad"),
}


def test_readings():
    assert {n: N.read_person(n) for n in PERSONS} == PERSONS
    assert {n: N.read_organisation(n) for n in ORGANISATIONS} == ORGANISATIONS


@settings(max_examples=200, deadline=None)
@given(st.text("abcde", max_size=12), st.text("abcde", max_size=12))
def test_common_subsequence_as_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    assert N.common_subsequence(a, b) == row[-1]


def pairs(spark, rows, **k):
    df = spark.createDataFrame(rows, "kind string, name string, entity string")
    return {(r["name_kind"], r["name_a"], r["name_b"]) for r in N.spelling_pairs(N.link_names(df, **k)).collect()}


def test_links(spark):
    one = ["Jonathan Brudoskem", "BRUDOSKEM, Jonathan", "Jon Brudoskem", "Brudoskem J", "Jonathan Brudosem", "Jonahtan Brudoskem"]
    other = ["Penelope Brudoskem", "Brudoskem P"]
    rows = [("person", n, "c") for n in [*one, *other, "Brudoskem X", "Jonathan Kelvastir", None, "", " n/a ", one[0], f" {one[0]} "]]
    rows += [("organisation", n, "c") for n in ["University of Bramstad", "Bramstad Univ.", "University of Bramstda", "Bramstad General Hospital", "Jonathan Brudoskem"]]
    expected = {("person", *sorted(p)) for group in (one, other) for p in itertools.combinations(group, 2)}
    expected |= {("organisation", *sorted(p)) for p in itertools.combinations(["University of Bramstad", "Bramstad Univ.", "University of Bramstda"], 2)}
    assert pairs(spark, rows) == expected
    assert pairs(spark, []) == set()


def test_an_initial_that_fits_two_people_ties_neither(spark):
    rows = [("person", n, "") for n in ("Maria Brudoskem", "Magnus Brudoskem", "Brudoskem M")]
    assert pairs(spark, rows) == set()


@pytest.mark.parametrize("max_block", [2, 40])
def test_one_letter_off_as_brute_force(spark, max_block):
    random.seed(6)
    syllables = ["bra", "dos", "kem", "vil", "tru", "pon", "gre", "sta"]
    mains = ["".join(random.choices(syllables, k=3)) for _ in range(60)]

    def slip(w):
        i = random.randint(0, len(w) - 2)
        return random.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "z" + w[i + 1 :]])

    spelled = sorted({f"{g.title()} {m.title()}" for m in mains for g in (random.choice(["anders", "birgit"]),) for m in (m, slip(m), slip(m))})
    read = {n: N.read_person(n) for n in spelled}
    up = {n: n for n in spelled}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(spelled, 2):
        # one edit or swap, which is what the exact keys promise
        (ga, ma), (gb, mb) = read[a], read[b]
        near = lambda u, v: bool({u} | {u[:i] + u[i + 1 :] for i in range(len(u))} & {v} or ({u} | {u[:i] + u[i + 1 :] for i in range(len(u))}) & ({v} | {v[:i] + v[i + 1 :] for i in range(len(v))}))
        if N.same_entity("person", ga, ma, gb, mb) and near(ma, mb):
            up[find(b)] = find(a)
    expected = {("person", a, b) for a, b in itertools.combinations(spelled, 2) if find(a) == find(b)}
    assert expected <= pairs(spark, [("person", n, "") for n in spelled], max_block=max_block)


def test_a_common_surname_still_links_slips_of_the_given_name(spark):
    given = ["Jonathan", "Penelope", "Kwame", "Ingrid", "Walter", "Xiulan", "Rosalind", "Theodore"]
    slips = ["Jonahtan", "Penelpe", "Kwwame", "Ingird", "Waltor", "Xiulann", "Roslind", "Thodore"]
    got = pairs(spark, [("person", f"{g} Brudoskem", "") for g in given + slips], max_block=2)
    assert got == {("person", *sorted((f"{a} Brudoskem", f"{b} Brudoskem"))) for a, b in zip(given, slips)}


def test_readings_with_their_parts_swapped_meet(spark):
    got = pairs(spark, [("person", n, "") for n in ("Brudoskem Jonathan", "Jonathan Brudoskem", "Penelope Quist", "Quist Walter")])
    assert got == {("person", "Brudoskem Jonathan", "Jonathan Brudoskem")}
