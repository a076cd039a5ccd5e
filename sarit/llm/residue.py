"""Problem 10: template residue and error-page text.

Method: normalised lines are counted by host (problem 5's operator: a host counts as its site, a document of a null
source takes the recurrent lines of all sources); the recurrent ones are subtracted; what is left of a document, its
residual, is searched for evidence. A placeholder or failed value in place of content is enough wherever it stands;
error messages, filler and notices of required scripts must make up at least half of the residual beside its title.
Sentences that speak of placeholders or quote one are no evidence.

Null, empty and blank texts are no cases, nor are texts of recurrent lines only. Texts are searched whole. Look-alike
and invisible characters don't hide evidence.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.llm.lookalike import plain_forms
from sarit.llm.repeated_lines import Lines, flagged_numbers
from sarit.plans.arrow import map_text
from sarit.plans.scale import table

#: Share of the residual beside its title that evidence of the second kind must make up.
MAIN = 0.5
#: Longest line, in characters, that can be a title.
TITLE = 90


def _compiled(pattern: str, flags: int = re.I) -> re.Pattern:
    return re.compile(unicodedata.normalize("NFD", pattern), flags)


# The forms of placeholders of common template languages.
_NAME = r"[A-Za-z_ऀ-ॿ][\w.ऀ-ॿ-]{0,60}"
PLACEHOLDER = _compiled(
    "|".join(
        [
            rf"\{{\{{\{{\s*{_NAME}\s*(?:\|[^{{}}\n]{{0,40}})?\}}\}}\}}",
            rf"\{{\{{\s*{_NAME}\s*(?:\|\s*\w*\s*)?\}}\}}",
            rf"[$#]\{{\s*{_NAME}\s*\}}",
            rf"<%[=-]?\s*{_NAME}\s*-?%>",
            rf"<\?(?:php\s+echo|=)?\s*\${_NAME}\s*;?\s*\?>",
            rf"\{{%\s*{_NAME}\s*%\}}",
            rf"\[%\s*{_NAME}\s*%\]",
            rf"@@{_NAME}@@",
            rf"(?<![\w%])%%?{_NAME}%%?(?![\w%])",
            r"(?<!\w)__[A-Za-zऀ-ॿ][\w.ऀ-ॿ-]{0,60}?__(?!\w)",
            rf"##{_NAME}##",
            rf"\*\|{_NAME}\|\*",
            rf"\[\[\s*{_NAME}\s*\]\]",
            r"\[(?:insert|your|enter|add|type)\s[^\]\n]{1,60}\]",
            r"\[[^\]\n]{1,60}\s(?:here|goes here|यहाँ लिखें|यहाँ डालें|यहाँ भरें|यहाँ लेख्नुहोस्|यहाँ राख्नुहोस्|यहाँ भर्नुहोस्|येथे लिहा|येथे भरा|इथे लिहा)\]",
        ]
    )
)
SINGLE_BRACE = _compiled(r"(?<![\w${])\{[a-z]+(?:[_.][a-z]+)*\}(?!\})|(?<![\w%])%[sd](?!\w)")
FAILED = _compiled(r"\bundefined\b|\bNaN\b|\bnull null\b|\(null\)|\bNone None\b|<nil>|\bnil nil\b|\bArray\b(?:\(\))?|\[object [A-Z]\w+\]|#(?:REF!|N/A\b|VALUE!|NAME\?|DIV/0!)", 0)
# Words of sentences that speak of such things.
SPEAKS = _compiled(
    r"लिखने|लिखा |लिखते|लेख्दा|लेखिन्छ|लेखेपछि|लिहिल्या|लिहिता|लिहिले|replac|\bsuch\b|templat|टेम्पलेट|टेम्प्लेट|placeholder|प्लेसहोल्डर|प्लेस होल्डर|जैसा|जैसे|जस्तो|जस्तै|उदाहरण|example|दिखता|देखिन्छ|दिसते|syntax|written as|means"
)
CODE = re.compile(r"[;{}=()<>]\s*$|^\s*[<{.}]|\bvar\b|\breturn\b|!=|==|\);")

# What error pages and script notices say.
ERROR = _compiled(
    "|".join(
        [
            # English
            r"enable (?:java)?scripts?|javascript[^.\n]{0,30}(?:required|disabled|enabled|needed|turned off|switched on)|needs? (?:java)?scripts?|scripts? and cookies|turn on (?:java)?scripts?",
            r"cookies?[^.\n]{0,30}(?:required|disabled|enabled|turned off)|enable cookies|checking your browser|browser check|one moment please|you are (?:a )?human|not a robot|captcha",
            r"access denied|permission to (?:view|access|open)|not authori[sz]ed|forbidden|bad gateway|gateway time-?out|upstream server|service unavailable|internal server error|fatal error|\berror \d{3}|http error",
            r"(?:page|file|article|address)[^.\n]{0,60}(?:not found|not be found|no longer|removed|deleted|been moved|does not exist|has changed)|(?:cannot|could not|can't|unable to|failed to) connect|database (?:error|connection)",
            r"something went wrong|server[^.\n]{0,30}(?:not responding|did not (?:answer|respond)|not answer|busy|is down)|(?:retry|try again)(?: later| in a)|session[^.\n]{0,20}expired|too many requests|traceback \(most|uncaught exception|under maintenance",
            # Hindi
            r"जावास्क्रिप्ट[^।\n]{0,60}(?:ज़रूरी|आवश्यक|चालू|सक्षम|बंद है)|स्क्रिप्ट[^।\n]{0,60}(?:अनुमति द|चालू कर|ज़रूरी|बंद है)|कुकी[^।\n]{0,60}(?:अनुमति|चालू|सक्षम|स्वीकार|ज़रूरी|बंद)|ब्राउज़र[^।\n]{0,40}(?:जाँच|चालू कर|सक्षम)|मनुष्य हैं|रोबोट नहीं",
            r"त्रुटि\s*(?:संख्या|कोड|क्रमांक)?\s*[\d०-९]|(?:पृष्ठ|पन्ना|पेज)[^।\n]{0,60}(?:नहीं मिला|नहीं मिल|उपलब्ध नहीं|मौजूद नहीं)|अनुमति नहीं|डेटाबेस[^।\n]{0,40}नहीं|सर्वर[^।\n]{0,40}(?:उत्तर नहीं|जवाब नहीं|व्यस्त है|बंद है)|लेख[^।\n]{0,30}हटा दिया गया|पता बदल गया|देर बाद[^।\n]{0,10}(?:कोशिश|प्रयास) कर|कुछ गड़बड़|सत्र समाप्त|रखरखाव",
            # Nepali
            r"जाभास्क्रिप्ट[^।\n]{0,60}(?:आवश्यक|सक्रिय|चाहिन्छ|जरुरी|बन्द छ)|स्क्रिप्ट[^।\n]{0,60}(?:अनुमति|सक्रिय|आवश्यक|बन्द)|कुकी[^।\n]{0,60}(?:अनुमति|सक्रिय|आवश्यक|बन्द)|ब्राउजर[^।\n]{0,40}(?:जाँच|सक्रिय)|(?:मानिस|मनुष्य|मानव) (?:हो|हुनु|भए)[^।\n]{0,30}(?:जाँच|पुष्टि)|(?:जाँच|पुष्टि)[^।\n]{0,60}(?:पर्खनुहोस्|प्रतीक्षा)",
            r"पृष्ठ[^।\n]{0,60}(?:भेटिएन|फेला परेन|उपलब्ध छैन)|अनुमति छैन|(?:डाटाबेस|डेटाबेस)[^।\n]{0,40}(?:सकिएन|भएन)|सर्भर[^।\n]{0,40}(?:जवाफ दि|उत्तर दि|व्यस्त|सकेन|सकिरहेको छैन)|लेख[^।\n]{0,30}हटाइ|ठेगाना[^।\n]{0,20}(?:बदलि|फेरि)|समयपछि[^।\n]{0,10}(?:प्रयास|कोसिस) गर|केही गडबड",
            # Marathi
            r"जा(?:वा|व्हा)स्क्रिप्ट[^.\n]{0,60}(?:आवश्यक|सुरू|गरजेचे|बंद आहे)|कुकी[^.\n]{0,60}(?:परवानगी|सुरू|आवश्यक)|ब्राउझर[^.\n]{0,40}(?:तपास|सुरू)|त्रुटी\s*(?:क्रमांक)?\s*[\d०-९]|(?:पान|पृष्ठ)[^.\n]{0,60}(?:सापडले नाही|उपलब्ध नाही)|परवानगी नाही|सर्व्हर[^.\n]{0,40}(?:उत्तर|प्रतिसाद)|लेख[^.\n]{0,30}(?:काढून|हटव)|वेळाने[^.\n]{0,20}प्रयत्न",
        ]
    )
)
FILLER = _compiled(r"(?:नमूना|नमुना|डमी) (?:पाठ|मजकूर|टेक्स्ट)[^।\n]{0,40}(?:बदल|फेर्नु|हटा)|(?:sample|dummy|placeholder|filler) text[^.\n]{0,40}(?:replace|change|here)|replace this text|your (?:text|content) (?:goes |will go )?here|(?:text|content) (?:goes|will go|comes) here|यहाँ (?:अपना|अपनी|आपका|आपकी|तपाईंको|तुमचा|तुमची|आपला) (?:पाठ|सामग्री|लेख|मजकूर)|(?:जगह|ठाउँमा|जागी)[^।\n]{0,30}(?:डालें|लिखें|भरें|राख्नुहोस्|लेख्नुहोस्|लिहा)")
# Parts of which every text that the patterns match has at least one; looked for first, being faster.
ERROR_STEMS = tuple(
    unicodedata.normalize("NFD", x)
    for x in (
        "script", "cookie", "browser", "one moment", "human", "robot", "captcha", "denied", "permission", "authori", "forbidden", "gateway", "upstream", "unavailable",
        "server", "fatal", "error", "not found", "not be found", "no longer", "removed", "deleted", "been moved", "not exist", "has changed", "connect", "database",
        "went wrong", "retry", "try again", "expired", "too many", "traceback", "exception", "maintenance",
        "स्क्रिप्ट", "कुकी", "ब्राउज", "ब्राउझर", "मनुष्य", "रोबोट", "त्रुट", "पृष्ठ", "पन्ना", "पेज", "अनुमति", "परवानगी", "डेटाबेस", "डाटाबेस", "सर्वर", "सर्भर", "सर्व्हर",
        "हटा दिया", "हटाइ", "हटव", "काढून", "पता बदल", "देर बाद", "समयपछि", "वेळाने", "कुछ गड़बड़", "केही गडबड", "सत्र", "रखरखाव", "पुष्टि", "जाँच", "ठेगाना", "सापडले नाही", "उपलब्ध नाही",
    )
)
FILLER_STEMS = tuple(unicodedata.normalize("NFD", x) for x in ("नमूना", "नमुना", "डमी", "text", "content", "यहाँ अप", "यहाँ आप", "यहाँ तप", "यहाँ तुम", "जगह", "ठाउँमा", "जागी"))
FAILED_STEMS = ("undefined", "NaN", "null", "[object", "None", "nil", "Array", "#")
PSEUDO_LATIN = re.compile(r"\b(?:lorem|ipsum|dolor)\b", re.I)
_ENGLISH = frozenset("the of and to in a is was for that with on at by from it there had more than if then as were about will have are be or not this".split())
_LATIN_WORD = re.compile(r"[A-Za-z]+")


def sentences(line: str) -> list[str]:
    """The pieces of a line up to a full stop, danda, question or exclamation mark followed by space or the end."""
    return [s for s in re.split(r"(?<=[।॥?!…])\s*|(?<=\.)\s+", line) if s.strip()]


def residual_lines(text: str, flags: set[int]) -> list[str]:
    """The lines that aren't recurrent; the forms of their characters are those of plain_forms."""
    return [x for i, x in enumerate(text.split("\n")) if i not in flags and x.strip()]


def evidence(lines: list[str]) -> str | None:
    """placeholder, failed value, error, filler, or None, of a residual."""
    if not lines:
        return None
    whole = "\n".join(lines)
    if any(x in whole for x in ("{", "%", "[", "@@", "__", "##", "<", "*|")) and (PLACEHOLDER.search(whole) or SINGLE_BRACE.search(whole)):
        for line in lines:
            code = bool(CODE.search(line))
            for match in [*PLACEHOLDER.finditer(line), *([] if code else SINGLE_BRACE.finditer(line))]:
                before = re.split(r"[।॥?!]", line[: match.start()])[-1]
                after = re.split(r"[।॥?!]", line[match.end() :])[0]
                if not SPEAKS.search(f"{before} {after}"):
                    return "placeholder"
    low = whole.lower()
    error = any(x in low for x in ERROR_STEMS) and ERROR.search(whole)
    filler = any(x in low for x in FILLER_STEMS) and FILLER.search(whole)
    latin = "lorem" in low or "ipsum" in low or "dolor" in low
    failed = any(x in whole for x in FAILED_STEMS) and FAILED.search(whole)
    first = lines[0]
    head = len(lines) > 1 and len(first) <= TITLE and not ((error and ERROR.search(first)) or (filler and FILLER.search(first)) or (latin and PSEUDO_LATIN.search(first)) or (failed and FAILED.search(first)))
    body = lines[1:] if head else lines
    size = sum(len(x) for x in body)
    if failed:
        for line in body:
            if not CODE.search(line) and FAILED.search(line):
                for piece in sentences(line):
                    hits = len(FAILED.findall(piece))
                    if hits and not SPEAKS.search(piece) and (hits > 1 or len(piece) >= MAIN * size):
                        return "failed value"
    if error and sum(len(s) for x in body for s in _notices(x) if ERROR.search(s)) >= MAIN * size:
        return "error"
    if filler and sum(len(s) for x in body for s in sentences(x) if FILLER.search(s)) >= MAIN * size:
        return "filler"
    often = next(iter(sentences(body[0])), "").strip()
    times = whole.count(often) if often else 0
    if times >= 3 and often.count(" ") >= 2 and times * len(often) >= 0.8 * size:
        return "filler"  # one sentence again and again
    if latin:
        hit = 0
        for line in body:
            words = _LATIN_WORD.findall(line.lower())
            if len(words) >= 2 and sum(map(len, words)) > 0.5 * len(line) and sum(w in _ENGLISH for w in words) <= 0.08 * len(words):
                hit += len(line)
        if hit >= MAIN * size:
            return "filler"
    return None


def _notices(line: str) -> list[str]:
    """The sentences of a line; a short line, with the address or number after its notice, as one."""
    return [line] if len(line) <= 2 * TITLE else sentences(line)


def residuals(batch: pa.RecordBatch, shared: object) -> list[list[str] | None]:
    """The residual of each row of a chunk of Lines.flagged(), None for a null text."""
    texts = batch.column("text").to_pylist()
    flags = flagged_numbers(batch, shared)
    kept = ["" if t is None else "\n".join(residual_lines(t, f)) if f else t for t, f in zip(texts, flags, strict=True)]
    return [None if t is None else [x for x in p.split("\n") if x.strip()] for t, p in zip(texts, plain_forms(kept), strict=True)]


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_reasons: doc_id, reason of every case."""
    flagged, shared = Lines(spark, sf_dir).flagged()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        said = [evidence(r) if r else None for r in residuals(batch, shared)]
        keep = pa.array([i for i, s in enumerate(said) if s], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(keep), pa.array([s for s in said if s], pa.string())], ["doc_id", "reason"])

    return map_text(flagged, run, "doc_id bigint, reason string").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: doc_id."""
    return reasons(spark, sf_dir).select("doc_id").distinct()


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_kept: source, n_documents, n_excluded: what excluding the cases leaves of each source (null is one too)."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source")
    cases = found(spark, sf_dir).withColumn("case", F.lit(1))
    return documents.join(cases, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count("case").alias("n_excluded"))
