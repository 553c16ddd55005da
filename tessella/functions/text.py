"""Cleaning of descriptions, keys made from text, and choices."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of what descriptions must not say, the field
# names, and the marks that replace or announce text.
DIAGNOSTIC = (
    r"(?i)\b(?:pancreatic ductal adenocarcinoma|ductal adenocarcinoma|adenocarcinoma|carcinoma|fibroadenoma|adenoma|cystadenoma|sarcoma|lymphoma|"
    r"melanoma|intraductal epithelial neoplasm|neuroendocrine neoplasm|solid pseudopapillary neoplasm|neoplasm|tumou?r category|diagnosis|benign|"
    r"malignant|malignancy)\b"
)
ORGAN = (
    r"(?i)\b(?:pancreas|pancreatic|breast|mammary|salivary gland|gastric|stomach|colorectal|colon|duodenal|duodenum|liver|hepatic|lung|pulmonary|"
    r"prostate|ovarian|ovary)\b"
)
ANCILLARY = r"(?i)\b(?:immunohistochem|molecular|mutation|clinical correlation|prognostic|CK7|CK20|CDX2|KRAS)\b"
MORPHOLOGY = (
    r"(?i)\b(?:gland|duct|papill|solid|nest|trabec|cell|nucle|cytoplas|stroma|desmoplas|fibro|mucin|necros|vessel|vascular|nerve|neural|inflamm|"
    r"architecture|atyp|mito|artifact|hemorrhage)\w*\b"
)
CONCLUSION = r"(?i)\b(?:consistent with|classification|rules? out|supports this)\b"
REPORT_ONLY = (
    r"(?i)\b(?:size|diameter|extent|stage|margin|(?:tumou?r|mass|lesion|carcinoma).{0,30}(?:size|diameter|measurement)|"
    r"(?:size|diameter|measurement).{0,30}(?:tumou?r|mass|lesion|carcinoma)|pathologic(?:al)?\s+stage|\btnm\b|\bpt[0-4]\b|\bpn[0-3]\b|estrogen|"
    r"progesterone|hormone\s+receptor|\bher-?2\b|\bki-?67\b|immunohistochem\w*|immunostain\w*|nuclear\s+staining|survival|follow[- ]?up|recurrence|"
    r"treatment|therapy|neo[- ]?adjuvant|patient(?:'s|’s)?\s+age|who\s+signed|pre[- ]?operative\s+diagnosis|sections?\s+(?:are\s+)?included|"
    r"which\s+breast)\b"
)
FIELDS = ("VISIBLE", "ABSENT_OR_NOT_SEEN", "UNCERTAIN", "QUALITY")
LABEL_MARK, ORGAN_MARK = "[diagnostic label omitted]", "[organ label omitted]"
NOT_RELIABLE = "No reliable direct morphology statement was returned."
NOT_STATED = (
    "\nABSENT_OR_NOT_SEEN: Not reliably stated.\nUNCERTAIN: Patch-level assessment only; diagnosis and organ identity were not assessed."
    "\nQUALITY: Not explicitly stated by the patch observer."
)
UNUSABLE = (
    "VISIBLE: No reliable morphology statement was returned.\nABSENT_OR_NOT_SEEN: Not assessed.\nUNCERTAIN: The patch-level output was an answer "
    "label rather than visual evidence.\nQUALITY: Unusable for visual classification."
)
SANITIZED_TAG = "[OFFLINE_MORPHOLOGY_SANITIZED] "
SENTENCES = r"(?<=[.!?])\s+|[\r\n]+"


def strip_thinking(text: Column) -> Column:
    """Without a leading ``<think>`` block, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", ""))


def visible_section(text: Column) -> Column:
    """From the first line ``VISIBLE:`` to ``ABSENT_OR_NOT_SEEN:`` or the end; all of a text without it.  Trimmed."""
    pattern = r"(?ims)^\s*VISIBLE\s*:\s*(.*?)(?=^\s*ABSENT_OR_NOT_SEEN\s*:|\z)"
    whole = F.coalesce(text, F.lit(""))
    section = F.when(whole.rlike(pattern), F.regexp_extract(whole, pattern, 1)).otherwise(whole)
    return F.regexp_replace(section, r"^\s+|\s+\z", "")


def redact(text: Column, labels: list[str]) -> Column:
    """Labels (the longer first), diagnostic and organ terms are replaced by their marks."""
    for label in sorted((x.strip() for x in labels if x and x.strip()), key=len, reverse=True):
        text = F.regexp_replace(text, "(?i)" + re.sub(r"([^\w\s])", r"\\\1", label), LABEL_MARK)
    return F.regexp_replace(F.regexp_replace(text, DIAGNOSTIC, LABEL_MARK), ORGAN, ORGAN_MARK)


def clean_sentences(text: Column, labels: list[str] = ()) -> Column:
    """The redacted sentences of a text that make no ancillary claim."""
    clean = redact(F.coalesce(text, F.lit("")), list(labels))
    sentences = F.transform(F.split(clean, SENTENCES), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))
    return F.filter(sentences, lambda s: (s != "") & ~s.rlike(ANCILLARY))


def tagged(sentences: Column) -> Column:
    return F.concat(F.lit(SANITIZED_TAG), F.array_join(sentences, " "))


def sanitize(text: Column, labels: list[str] = ()) -> Column:
    """Redacted sentences without ancillary claims, after a tag."""
    return tagged(clean_sentences(text, labels))


def normalize_morphology(text: Column, version: str, labels: list[str] = ()) -> Column:
    """A description in four fields: letters and bare labels are rejected, other text is redacted and, without the fields, reduced to sentences on form."""
    raw = F.trim(strip_thinking(F.coalesce(text, F.lit(""))))
    answer = r"(?is)^\s*<answer>\s*(.*?)\s*</answer>\s*\z"
    said = F.trim(F.when(raw.rlike(answer), F.regexp_extract(raw, answer, 1)).otherwise(raw))
    names = [x.strip().lower() for x in labels if x and x.strip()]
    bare = said.rlike(r"^[A-Za-z]\z") | (F.lower(said).isin(names) if names else F.lit(False)) | (said == "")
    clean = redact(said, list(labels))
    fields = [clean.rlike(rf"(?im)^\s*{f}\s*:") for f in FIELDS]
    complete = fields[0] & fields[1] & fields[2] & fields[3]
    lines = F.array_join(F.filter(F.split(clean, r"\r\n|\n|\r"), lambda s: ~s.rlike(ANCILLARY)), "\n")
    sentences = F.transform(F.split(clean, SENTENCES), lambda s: F.regexp_replace(s, r"^[ \-*\t]+|[ \-*\t]+\z", ""))
    sentences = F.filter(sentences, lambda s: (s != "") & ~s.rlike(ANCILLARY))
    sentences = F.transform(sentences, lambda s: F.replace(F.replace(s, F.lit(LABEL_MARK), F.lit("")), F.lit(ORGAN_MARK), F.lit("")))
    sentences = F.transform(sentences, lambda s: F.regexp_replace(s, r"(?i)^\s*VISIBLE\s*:\s*(?:with|showing|characterized by|composed of)\s+", "VISIBLE: "))
    sentences = F.filter(sentences, lambda s: ~s.rlike(CONCLUSION) & s.rlike(MORPHOLOGY))
    prose = F.array_join(F.transform(sentences, lambda s: F.regexp_replace(s, r"(?i)^(?:key )?features include\s*", "")), " ")
    visible = F.when(prose != "", prose).otherwise(NOT_RELIABLE)
    rebuilt = F.concat(F.lit("VISIBLE: "), visible, F.lit(NOT_STATED))
    body = F.when(bare, F.lit(UNUSABLE)).when(complete, lines).otherwise(rebuilt)
    return F.concat(F.lit(f"[PATHO_MORPHOLOGY | {version}]\n"), body)


def letter_to_choice(text: Column, choices: Column) -> Column:
    """An answer that is one letter becomes the choice of that letter; other text stays."""
    said = strip_thinking(text)
    letter = F.upper(F.regexp_extract(said, r"(?i)^\s*<answer>\s*([A-Z])\s*</answer>\s*\z", 1))
    choice = F.try_element_at(choices, F.when(letter != "", F.ascii(letter) - 64).otherwise(F.lit(1)).cast("int"))
    return F.when((letter != "") & choice.isNotNull(), F.concat(F.lit("<answer>"), choice, F.lit("</answer>"))).otherwise(said)


def parse_choices(choices: Column) -> Column:
    """Choices from a JSON array of strings, or else from a text parted by ``|``; empty parts go."""
    parts = F.filter(F.transform(F.split(choices, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(choices, "array<string>"), parts)


def unique_id(long_id: Column, question: Column) -> Column:
    return F.concat_ws("_", long_id, F.substring(F.md5(question.cast("binary")), 1, 8))


def coordinates(name: Column) -> Column:
    """x and y from a name that begins ``x_y``; both null otherwise."""
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    x, y = (F.split_part(stem, F.lit("_"), F.lit(i)).try_cast("long") for i in (1, 2))
    both = x.isNotNull() & y.isNotNull()
    return F.struct(F.when(both, x).alias("x"), F.when(both, y).alias("y"))


def is_report_only(question: Column) -> Column:
    """Whether a question asks for what only a report says."""
    return F.coalesce(question.rlike(REPORT_ONLY), F.lit(False))


#: Fixed value: the choice where none says that the evidence does not suffice.
INSUFFICIENT = "Insufficient evidence"


def insufficient_in(choices: Column) -> Column:
    """The first choice that says that the evidence does not suffice, or null."""
    return F.try_element_at(F.filter(choices, lambda c: F.lower(c).contains("insufficient") | c.contains("证据不足")), F.lit(1))


def insufficient_choice(choices: Column, multiple: bool = False) -> Column:
    """The choice that says that the evidence does not suffice, or else a constant; a list of it where answers are lists."""
    one = F.coalesce(insufficient_in(choices), F.lit(INSUFFICIENT))
    return F.array(one) if multiple else one


def fallback_choice(choices: Column) -> Column:
    return F.coalesce(F.try_element_at(choices, F.lit(1)), F.lit(""))


def safe_focus(text: Column, choices: Column, generic: str = "visible morphology") -> Column:
    """A focus without diagnostic words and choices; one that names a diagnosis becomes ``generic``."""
    focus = F.trim(F.coalesce(text, F.lit("")))
    # Words that make a focus a diagnosis.
    named = r"(?i)tumou?r category|adenocarcinoma|neoplasm|neuroendocrine|pseudopapillary|diagnosis"
    plain = F.aggregate(choices, focus, lambda s, c: F.replace(s, c, F.lit("visible target morphology")))
    return F.when((focus == "") | focus.rlike(named), F.lit(generic)).otherwise(plain)
