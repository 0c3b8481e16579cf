"""Builders of small call files: read counts in, call-file text out."""

import csv
import json
import math
from dataclasses import dataclass, replace
from pathlib import Path

COLUMNS = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()
HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=chr7,length=200000>", "##contig=<ID=chr9,length=200000>", "##contig=<ID=chrX,length=156040895>"]
CHILD = ("ann", "ben", "cat")  # child, father, mother


def phred(ref, alt, copies):
    """Scaled likelihoods of 0..copies ALT copies under one error in a thousand."""
    rates = [min(max(k / copies, 0.001), 0.999) for k in range(copies + 1)]
    raw = [-10 * (alt * math.log10(p) + ref * math.log10(1 - p)) for p in rates]
    return ",".join(str(round(x - min(raw))) for x in raw)


@dataclass(frozen=True)
class Reads:
    gt: str
    ref: int
    alt: int
    gq: int = 70
    strands: bool = True

    def cell(self):
        copies = len(self.gt.replace("|", "/").split("/"))
        text = f"{self.gt}:{self.ref},{self.alt}:{self.ref + self.alt}:{self.gq}:{phred(self.ref, self.alt, copies)}"
        cut = self.ref // 2, self.ref - self.ref // 2, self.alt // 2, self.alt - self.alt // 2
        return text + (":" + ",".join(map(str, cut)) if self.strands else "")


def hom(depth, **kw):
    return Reads("0/0", depth, 0, **kw)


@dataclass(frozen=True)
class Row:
    pos: int
    members: tuple
    chrom: str = "chr7"
    ref: str = "G"
    alt: str = "A"
    info: str = "MQ=58;FS=2.5;SOR=0.9;gnomAD_AF=0"
    filt: str = "PASS"

    def line(self):
        form = "GT:AD:DP:GQ:PL" + (":SB" if self.members[0].strands else "")
        return "\t".join([self.chrom, str(self.pos), ".", self.ref, self.alt, "90", self.filt, self.info, form, *(m.cell() for m in self.members)])

    def but(self, **kw):
        return replace(self, **kw)


def calls(path: Path, lines, samples=CHILD, head=HEAD):
    path.write_text("\n".join([*head, "\t".join([*COLUMNS, *samples]), *(r.line() if isinstance(r, Row) else r for r in lines)]) + "\n")
    return str(path)


def pedigree(path: Path, sex="2", members=CHILD):
    child, father, mother = members
    path.write_text("".join("\t".join(r) + "\n" for r in (["P1", child, father, mother, sex, "2"], ["P1", father, "0", "0", "1", "1"], ["P1", mother, "0", "0", "2", "1"])))
    return str(path)


def reference(path: Path, contigs):
    """A FASTA of 50 bases a line and its index."""
    entries, at = [], 0
    with open(path, "w") as out:
        for name, bases in contigs.items():
            at += out.write(f">{name}\n")
            entries.append((name, len(bases), at, 50, 51))
            for i in range(0, len(bases), 50):
                at += out.write(bases[i:i + 50] + "\n")
    Path(f"{path}.fai").write_text("".join("\t".join(map(str, e)) + "\n" for e in entries))
    return str(path)


def rows_of(path):
    return list(csv.DictReader(open(path), delimiter="\t"))


def json_of(path):
    return json.loads(Path(path).read_text())
