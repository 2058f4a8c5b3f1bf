"""Cancer types from site and histology codes, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ICD-O site prefixes and histology codes of each schema.
NAACCR_SITES = {
    "lung": ("C34",), "breast": ("C50",), "prostate": ("C61",), "colorectal": ("C18", "C19", "C20"), "kidney": ("C64",), "bladder": ("C67",),
    "pancreas": ("C25",), "thyroid": ("C73",), "liver": ("C22",), "esophagus": ("C15",), "stomach": ("C16",), "ovary": ("C56",),
    "uterus": ("C54", "C55"), "cervix": ("C53",), "testis": ("C62",), "brain": ("C71",),
    "head_neck": ("C00", "C01", "C02", "C03", "C04", "C05", "C06", "C07", "C08", "C09", "C10", "C11", "C12", "C13", "C14", "C30", "C31", "C32"),
}
MELANOMA = (
    "8720", "8721", "8722", "8723", "8725", "8726", "8727", "8728", "8730", "8740", "8741", "8742", "8743", "8744", "8745", "8746",
    "8761", "8770", "8771", "8772", "8773", "8774", "8780",
)
LYMPHOMA = (
    "9590", "9591", "9596", "9597", "9650", "9651", "9652", "9653", "9654", "9655", "9659", "9661", "9662", "9663", "9664", "9665",
    "9667", "9670", "9671", "9673", "9675", "9678", "9679", "9680", "9684", "9687", "9688", "9689", "9690", "9691", "9695", "9698",
    "9699", "9700", "9701", "9702", "9705", "9708", "9709", "9712", "9714", "9716", "9717", "9718", "9719", "9724", "9725", "9726",
    "9727", "9728", "9729",
)
LEUKEMIA = (
    "9800", "9801", "9805", "9806", "9807", "9808", "9809", "9811", "9812", "9813", "9814", "9815", "9816", "9817", "9818", "9820",
    "9823", "9826", "9827", "9831", "9832", "9833", "9834", "9835", "9836", "9837", "9840", "9860", "9861", "9863", "9865", "9866",
    "9867", "9869", "9870", "9871", "9872", "9873", "9874", "9875", "9876", "9891", "9895", "9896", "9897", "9898", "9910", "9911",
    "9920", "9930", "9931", "9940", "9945", "9946", "9948", "9963", "9964", "9965", "9966", "9967", "9975",
)
MYELOMA = ("9731", "9732", "9733", "9734")
SMALL_CELL = ("8041", "8042", "8043", "8044", "8045")
PRISSMM_SITES = {"nsclc": ("C34",), "breast": ("C50",), "colorectal": ("C18", "C19", "C20")}
PAN_TOP_SITES = {"lung": ("C34",), "mesothelioma": ("C45", "C384"), "thymus": ("C37", "D150")}
OMOP_SITES = {"breast": ("C50",), "colorectal": ("C18", "C19", "C20"), "prostate": ("C61",), "melanoma": ("C43",), "kidney": ("C64",), "pancreas": ("C25",)}
MATCHMINER_SITES = {"breast": ("C50",), "colorectal": ("C18", "C19", "C20"), "prostate": ("C61",), "melanoma": ("C44",), "ovarian": ("C56",), "pancreatic": ("C25",), "gastric": ("C16",), "renal": ("C64",), "bladder": ("C67",), "thyroid": ("C73",)}
CHORD_SITES = {
    "lung": ("C34",), "breast": ("C50",), "colorectal": ("C18", "C19", "C20"), "prostate": ("C61",), "melanoma": ("C43",), "kidney": ("C64",), "pancreas": ("C25",),
    "bladder": ("C67",), "ovarian": ("C56",), "endometrial": ("C54",), "glioma": ("C71",),
    "head_neck": ("C00", "C01", "C02", "C03", "C04", "C05", "C06", "C07", "C08", "C09", "C10", "C11", "C12", "C13", "C14"), "thyroid": ("C73",), "liver": ("C22",), "gastric": ("C16",), "esophageal": ("C15",),
}
CHORD_CODES = {
    "lung": ("LUAD", "LUSC", "NSCLC", "SCLC", "LUNE", "LUNG"), "breast": ("BRCA", "IDC", "ILC", "BREAST"), "colorectal": ("COAD", "READ", "CRC", "COADREAD"),
    "prostate": ("PRAD", "PROSTATE"), "melanoma": ("MEL", "SKCM", "UM"), "pancreas": ("PAAD", "PANET", "PANCREAS"),
    "kidney": ("CCRCC", "PRCC", "CHRCC", "RCC", "KIDNEY"), "bladder": ("BLCA", "BLADDER"), "ovarian": ("OV", "HGSOC", "OVARY"),
    "endometrial": ("UCEC", "UCS", "UTERUS"), "glioma": ("GBM", "LGG", "BRAIN"), "head_neck": ("HNSC", "HEADNECK"), "thyroid": ("THCA", "THYROID"),
    "liver": ("HCC", "LIHC", "LIVER"), "gastric": ("STAD", "STOMACH"), "esophageal": ("ESCA", "ESOPHAGUS"), "sarcoma": ("SARC", "SARCOMA"),
    "leukemia": ("AML", "ALL", "CLL", "CML", "LEUKEMIA"), "lymphoma": ("DLBCL", "FL", "HL", "NHL", "LYMPHOMA"), "myeloma": ("MM", "MYELOMA"),
}


def normal_site(code: Column, drop: str = ". ") -> Column:
    return F.upper(F.translate(F.coalesce(code, F.lit("")), drop, ""))


def _first(cases: Iterable[tuple[Column, str | Column]], default: str = "generic") -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1]) if isinstance(case[1], str) else case[1]).otherwise(rest), reversed(list(cases)), F.lit(default))


def _by_prefix(site: Column, table: Mapping[str, Sequence[str]]) -> list[tuple[Column, str]]:
    """One membership test per type; longer prefixes of a type are tested by themselves."""
    out = []
    for kind, prefixes in table.items():
        by_length: dict[int, list[str]] = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        out.append((reduce(lambda a, b: a | b, [F.substring(site, 1, n).isin(*ps) for n, ps in by_length.items()]), kind))
    return out


def naaccr(site: Column, histology: Column, year: Column) -> Column:
    code, four = normal_site(site), F.substring(F.coalesce(histology.cast("string"), F.lit("")), 1, 4)
    among = lambda codes: four.isin(*codes)
    cases: list = [(among(MYELOMA), "myeloma"), (among(LEUKEMIA), "leukemia"), (among(LYMPHOMA), "lymphoma"), (code.startswith("C44") & among(MELANOMA), "melanoma")]
    for test, kind in _by_prefix(code, NAACCR_SITES):
        cases.append((test, F.when(year >= 2025, "lung_v9").otherwise("lung") if kind == "lung" else kind))
    return _first(cases)


def prissmm(site: Column) -> Column:
    return _first(_by_prefix(normal_site(site), PRISSMM_SITES))


def pan_top(site: Column) -> Column:
    return _first(_by_prefix(normal_site(site), PAN_TOP_SITES))


def _small_cell(code: Column, histology: Column) -> list[tuple[Column, str]]:
    small = F.coalesce(F.substring(histology.cast("string"), 1, 4).isin(*SMALL_CELL), F.lit(False))
    return [(code.startswith("C34") & small, "sclc"), (code.startswith("C34"), "nsclc")]


def omop(site: Column, histology: Column) -> Column:
    code = normal_site(site, ".")
    return _first([*_small_cell(code, histology), *_by_prefix(code, OMOP_SITES)])


def matchminer_ai(site: Column, histology: Column) -> Column:
    code = normal_site(site, ".")
    return _first([*_small_cell(code, histology), *_by_prefix(code, MATCHMINER_SITES)])


def msk_chord(site: Column) -> Column:
    """Tumour-type codes contained either way come before site prefixes."""
    code = normal_site(site, ".-_ ")
    cases: list = [(code == "", "generic")]
    for kind, codes in CHORD_CODES.items():
        cases.append((reduce(lambda a, b: a | b, [F.contains(code, F.lit(c)) | F.contains(F.lit(c), code) for c in codes]), kind))
    return _first([*cases, *_by_prefix(code, CHORD_SITES)])


def detect(ontology: str, site: Column, histology: Column, year: Column) -> Column:
    match ontology:
        case "naaccr":
            return naaccr(site, histology, year)
        case "prissmm":
            return prissmm(site)
        case "pan_top":
            return pan_top(site)
        case "omop":
            return omop(site, histology)
        case "matchminer_ai":
            return matchminer_ai(site, histology)
        case "msk_chord":
            return msk_chord(site)
    return F.lit("generic")
