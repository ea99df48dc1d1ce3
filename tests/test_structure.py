"""Folding against the enumeration of all chains of pairs, and the queries without SQL against plain re-statements."""

import random

import numpy as np
import pytest

from strandlake.functions import structure as S
from strandlake.plans import base as B
from strandlake.plans import design
from strandlake.plans import queries as plans

CODE = {c: i for i, c in enumerate("ACGT")}


def paired(a, b):
    return CODE[a] + CODE[b] == 3


def step(x, y, u, v):
    return S.STEP[CODE[x], CODE[y], CODE[u], CODE[v]]


def end(x):
    return S.END_AT if x in "AT" else 0.0


def inner(s, i, j, k, m):
    """Between the pairs (i, j) and (k, m): i < k on the one side, m < j on the other."""
    up, down = k - i - 1, j - m - 1
    if up + down > S.WIDEST:
        return None
    if not up and not down:
        return step(s[i], s[k], s[j], s[m])
    if up == down == 1:
        return step(s[i], s[i + 1], s[j], s[j - 1]) + step(s[i + 1], s[k], s[j - 1], s[m])
    if not up or not down:
        if up + down == 1:
            return S.BULGE[1] + step(s[i], s[k], s[j], s[m])
        return S.loop_energy(S.BULGE, up + down) + end(s[i]) + end(s[k])
    g = S.loop_energy(S.INTERIOR, up + down) + S.ASYMMETRY * abs(up - down)
    if not paired(s[i + 1], s[j - 1]):
        g += step(s[i], s[i + 1], s[j], s[j - 1])
    if not paired(s[k - 1], s[m + 1]):
        g += step(s[k - 1], s[k], s[m + 1], s[m])
    return g


def dangling(s, five, pair5, three, pair3):
    """Dangling bases at one end: `five` is 5' of the base pair5, `three` is 3' of pair3."""
    g = end(s[pair5])
    if 0 <= five < len(s):
        g += min(0.0, S.BEFORE[CODE[s[pair5]], CODE[s[five]]])
    if 0 <= three < len(s):
        g += min(0.0, S.BEHIND[CODE[s[pair3]], CODE[s[three]]])
    return g


def hairpin(s):
    n = len(s)

    def closed(i, j):
        loop = j - i - 1
        g = S.loop_energy(S.HAIRPIN, loop)
        g += end(s[i]) if loop == 3 else 0.0 if paired(s[i + 1], s[j - 1]) else step(s[i], s[i + 1], s[j], s[j - 1])
        yield g
        for k in range(i + 1, j):
            for m in range(k + 4, j):
                if paired(s[k], s[m]) and (g := inner(s, i, j, k, m)) is not None:
                    yield from (g + rest for rest in closed(k, m))

    return min([0.0, *(dangling(s, i - 1, i, j + 1, j) + g for i in range(n) for j in range(i + 4, n) if paired(s[i], s[j]) for g in closed(i, j))])


def dimer(s):
    n = len(s)

    def from_pair(i, j):
        yield dangling(s, j - 1, j, i + 1, i)
        for k in range(i + 1, n):
            for m in range(j):
                if paired(s[k], s[m]) and (g := inner(s, i, j, k, m)) is not None:
                    yield from (g + rest for rest in from_pair(k, m))

    return min([0.0, *(S.INITIATION + dangling(s, i - 1, i, j + 1, j) + g for i in range(n) for j in range(n) if paired(s[i], s[j]) for g in from_pair(i, j))])


def code(seqs):
    return np.array([[CODE[c] for c in s] for s in seqs])


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 10])
def test_dimers_equal_enumeration(n):
    r = random.Random(n)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for _ in range(6)] + ["GC" * n][:1]
    seqs = [s[:n] for s in seqs]
    assert np.allclose(S.dimers(code(seqs)), [dimer(s) for s in seqs])


@pytest.mark.parametrize("n", [3, 5, 9, 13, 16])
def test_hairpins_equal_enumeration(n):
    r = random.Random(n)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for _ in range(8)] + ["GGGAC" + "A" * n, "GCGCGAAAGCGCGC" + "T" * n]
    seqs = [s[:n] for s in seqs]
    assert np.allclose(S.hairpins(code(seqs)), [hairpin(s) for s in seqs])


def test_energies_of_known_helices():
    # GCGC with itself: stacks -2.24 (GC), -2.17 (CG), -2.24 (GC), initiation 1.96, no A-T end
    assert S.free_energies(["GCGC"])[0] == pytest.approx(1.96 - 2.24 - 2.17 - 2.24, abs=0.03)
    assert S.free_energies(["AAAAAAAAAA", "", None, "ACGNACGT"]).tolist() == [0, 0, 0, 0]
    assert S.free_energies(["gggggaaaaccccc"])[0] == S.free_energies(["GGGGGAAAACCCCC"])[0] < -4
    assert S.free_energies(["GGGGGAAAACCCCC"])[0] == min(hairpin("GGGGGAAAACCCCC"), S.dimers(code(["GGGGGAAAACCCCC"]))[0])


def test_secondary_structure_query(spark, sf):
    got = {(r.gene_id, r.start): r.penalty for r in plans.QUERIES["secondary_structure"](spark, sf).collect()}
    probes = B.candidates(spark, sf).collect()
    assert set(got) == {(r.gene_id, r.start) for r in probes} and all(0 <= x <= 1 for x in got.values())
    r = random.Random(1)
    for p in r.sample(probes, 12):
        one = S.free_energies([p.seq])[0]
        assert got[p.gene_id, p.start] == pytest.approx(min(1, -one / 10)) and one <= min(hairpin(p.seq[:14]), hairpin(p.seq[-14:])) + 1.0


def test_design_host_internal_query(spark, sf):
    """Every probe's alignments by enumeration over the hits, its groups, and the k-mer screen."""
    got = {r.probe_id: (r.start, r.end, r.status, r.reason) for r in plans.QUERIES["design_host_internal"](spark, sf).collect()}
    genes, contigs = B.genes(spark, sf), B.contigs(spark, sf)
    d = design.of_genes(genes, contigs, design.Options(host_internal=True), gene_map=B.gene_map(spark, sf))
    probes = {r.probe_id: r for r in d.candidates.collect()}
    gene_of, bare = {}, {}
    for r in B.gene_map(spark, sf).collect():
        gene_of[r.transcript] = r.gene
        b = r.transcript.split(".")[0]
        bare[b] = min(r.gene, bare.get(b, r.gene))
    texts = {r.contig: r.seq for r in contigs.collect()}
    groups, sites = {}, {}
    comp = str.maketrans("ACGT", "TGCA")
    seeds = {}
    for name, p in probes.items():
        for q in (p.seq, p.seq.translate(comp)[::-1]):
            for k in range(3):
                seeds.setdefault(q[12 * k : 12 * k + 12], []).append((name, q, 12 * k))
    for contig, s in texts.items():
        for i in range(len(s) - 11):
            for name, q, off in seeds.get(s[i : i + 12], ()):
                t = s[i - off : i - off + 36] if i >= off else ""
                if len(t) == 36 and sum(a != b for a, b in zip(q, t, strict=True)) <= 2:
                    b = contig.split(".")[0]
                    groups.setdefault(name, set()).add(gene_of.get(contig, bare.get(b, b)))
                    sites.setdefault(name, set()).add(contig)
    safe = {name for name, g in groups.items() if len(g) == 1}
    # the source is what the safe probes of a job lie on; k-mers on it are excused
    own = {}
    for name in safe:
        own.setdefault(probes[name].job, set()).update(sites[name])
    words = {}
    for name in safe:
        p = probes[name]
        for i in range(21):
            w = p.seq[i : i + 16]
            words.setdefault(min(w, w.translate(comp)[::-1]), set()).add(name)
    total, mine = {}, {}
    jobs = {c.split(".")[0]: {j for j, cs in own.items() if c.split(".")[0] in {x.split(".")[0] for x in cs}} for c in texts}
    for contig, s in texts.items():
        for i in range(len(s) - 15):
            w = s[i : i + 16]
            w = min(w, w.translate(comp)[::-1])
            if w in words:
                total[w] = total.get(w, 0) + 1
                for j in jobs[contig.split(".")[0]]:
                    mine[j, w] = mine.get((j, w), 0) + 1
    bad = {n for w, names in words.items() for n in names if total.get(w, 0) > mine.get((probes[n].job, w), 0)}
    want = {}
    for name, p in probes.items():
        if name in safe:
            want[name] = (p.start, p.end, "medium_risk", "kmer") if name in bad else (p.start, p.end, "safe", None)
        else:
            want[name] = (p.start, p.end, "no_alignment", "kmer")
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
