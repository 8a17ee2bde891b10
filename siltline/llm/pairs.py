"""Defects of question and answer pairs, by ordered rules.

The rules, in their order: emptiness, copied question, refusal, script or language mismatch, truncation (abrupt
endings, unclosed delimiters). Every rule that a pair triggers is given. A table is judged in one scan without a
shuffle, in Arrow batches: each text is folded and cut into words once, and the costly patterns are tried only where a
word that they all need is there. The same rules as SQL expressions took four times the CPU seconds.

Defined results: a null answer is empty; a null question is taken as empty text, so nothing copies it and
no language is held against it; answers without small words have no language; a refusal is one of any length whose first
sentence declines; repeated rows are judged apart; a column named ``defects`` is replaced.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siltline.session import out_schema, widened

# Texts that stand for a missing answer.
PLACEHOLDERS = ["n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "no answer", "not answered", "not available", "empty", "unknown", "pending", "placeholder", "keine antwort", "sans réponse", "sin respuesta", "sem resposta", "xxx", "lorem ipsum"]
# Openings that may stand before a refusal, and the refusals, by language.
OPENINGS = (
    r"(?:i'?m (?:very |really |so )?sorry|i am sorry|sorry|i apologi[sz]e|my apologies|apologies|unfortunately|regrettably|with regret|to be honest|after some thought|as an? (?:ai|assistant|language model)[^,.]*"
    r"|thank you for asking|thanks for asking|lo siento|lamentablemente|perdón|désolée?|je suis désolée?|malheureusement|je regrette|tut mir leid|es tut mir leid|leider|entschuldigung|bedaure"
    r"|desculpe|lamento|infelizmente|mi dispiace|purtroppo|scusa|helaas|het spijt me|sorry)"
)
REFUSALS = [
    r"i (?:must|have to|need to|will have to) (?:decline|refuse)",
    r"i would rather not (?:respond|answer|say|discuss|reply|comment)",
    r"no (?:reply|answer|response) can be given",
    r"(?:i cannot|i can'?t|i can not|i am unable to|i'?m unable to|i am not able to|i'?m not able to|i won'?t|i will not|i may not) (?:provide|answer|give|help|assist|respond|reply|discuss|comment|comply|offer|support|share|say)",
    r"(?:is not|isn'?t) something i (?:can|could|am able to) (?:assist|help|answer|discuss|do)",
    r"answering (?:this|that) would (?:go against|violate|break)",
    r"(?:i do not|i don'?t) feel comfortable",
    r"it would be (?:inappropriate|wrong|improper|irresponsible)",
    r"(?:i won'?t|i will not) be (?:answering|discussing|responding|helping)",
    r"outside (?:of )?what i am (?:permitted|allowed|able) to",
    r"i (?:may|can|could|must|should) not (?:comment|answer|discuss|respond)",
    r"i (?:have to|must|will) pass on|i (?:have to|must) (?:skip|leave out) (?:this|that|questions)",
    r"(?:asked|ask|consult|contact) (?:somebody|someone) else",
    r"against my (?:guidelines|rules|policy|policies|principles)",
    r"i am not (?:allowed|permitted) to|i'?m not (?:allowed|permitted) to",
    r"no (?:puedo|podemos|me es posible|estoy en condiciones de|debo|me está permitido)\b.{0,25}(?:responder|ayudar|contestar|proporcionar|dar)",
    r"prefiero no (?:responder|contestar|hablar)",
    r"(?:je ne (?:peux|puis|suis)|il m'est impossible de|je préfère ne|nous ne pouvons).{0,40}(?:répondre|aider|fournir|donner|réponse|traiter|parler)",
    r"(?:kann|darf|möchte|werde) ich .{0,40}(?:nicht|keine)|(?:kann|darf) .{0,20}nicht (?:beantworten|helfen)|ich (?:kann|darf|möchte) .{0,50}(?:nicht|keine) .{0,30}(?:beantworten|antworten|helfen|geben|sagen)|nicht (?:beantworten|helfen)\b",
    r"não (?:posso|me é possível|consigo|devo).{0,30}(?:responder|ajudar|fornecer|dar)|prefiro não responder",
    r"non (?:posso|mi è possibile|sono in grado di).{0,30}(?:rispondere|aiutare|fornire|dare)|preferisco non rispondere",
    r"(?:kan|mag|wil) ik .{0,30}(?:niet|geen)|ik (?:kan|mag|wil) .{0,40}(?:niet|geen) .{0,20}(?:beantwoorden|helpen|geven)",
]
# Frequent small words that belong to one language more than to the others.
SMALL_WORDS = {
    "en": "the and of to is are was were with for that this which when what how does would you your before after because from by only can it its not an as at be on if or how why many explain describe we our each than then other nobody until whenever without into within through while there us they has have had",
    "de": "der die das und nicht ist sind war wir wie was wenn mit für auf dem den des ein eine einer man sich auch nach von zu zum zur warum welche sie ich hatte wegen erst schon immer heute unser unsere dass jetzt ohne nützt wer deshalb lohnt sollte haben mussten gestern",
    "fr": "le les des est une dans pour que qui nous vous avec sur pas plus sont était du au aux et ou quand comment pourquoi cela même ne ce cette qu il elle faut déjà lorsque parce avait mieux avant après apres depuis chaque notre nos voulait hier maintenant",
    "es": "el los las del una para por que con cómo qué cuando muy pero más lo sin ya está son se y nuestra nuestro había desde antes después porque es al si quería unas siempre despues menudo cada ni siquiera ayer mejor ahora",
    "pt": "os as uma para por que com como quando mas mais não são dos das no na em do da e nossa nosso tinha desde antes depois porque sem já está pelo pela um ao isso o sempre foi cada nem mesmo muitas vezes ontem melhor agora",
    "it": "il gli una per che con come quando ma più non sono della dei delle nel di e nostra nostro aveva prima dopo perché senza già è al si del le cosa questo quanto dal ogni anche spesso meglio ieri ora nemmeno abbiamo",
    "nl": "de het een van en niet is zijn was wij we wat hoe waarom wanneer met voor op ook naar te om dat die onze ons had omdat zonder al worden kun je meer bij dan ze elk vaak wordt later beter sinds gisteren nu",
}
# Words of which each refusal holds one at least; without any of them no pattern is tried.
REFUSAL_WORDS = frozenset("decline refuse rather given cannot can can't unable able won't not isn't would comfortable inappropriate wrong improper irresponsible permitted allowed pass skip leave somebody someone against no prefiero peux puis suis m'est impossible préfère pouvons nicht keine não prefiro non preferisco niet geen".split())
_CODE = r"^\s*(?:@\w+|[\w.]+\([^)]*\)\s*|.*[;{}]\s*|(?:SELECT|MERGE INTO|VACUUM|OPTIMIZE|INSERT INTO|UPDATE|DELETE FROM|CREATE|DROP|ALTER|WITH|FROM)\b.*|(?:import|from) [\w.]+(?: import .*)?|def \w+\(.*|class \w+.*:|[\w.]+\.\w+\(.*\)|\[[^\]]*\]|\w+ ?= ?\S.*)$"
_BULLET = r"^\s*(?:[-*•–+]|\d+[.)])\s+\S"
# what sources put behind a cut; a fourth dot before three of them is the sentence's own
_DOTS = r"\s*(?:[\[(](?:\.{3}|…)[\])]|(?:\.{3}|…)+)\s*$"

LANGUAGES = list(SMALL_WORDS)
LANGUAGES_OF = {w: tuple(k for k, ws in enumerate(SMALL_WORDS.values()) if w in ws.split()) for ws in SMALL_WORDS.values() for w in ws.split()}
_LABEL = re.compile(r"^(?:(?:answer|a|you asked|good question|great question|question|q|interview|antwort|frage|réponse|respuesta|pregunta|resposta|pergunta|risposta|domanda|antwoord|vraag|well|so|ok) )+")
_NUMBER = re.compile(r"^\d+ ")
_REST = re.compile(r"\b(?:answer|you asked|good question|question|interview|antwort|frage|q|a|\d+)\b")
_OPENING = re.compile(rf"^\s*(?:{OPENINGS}\s*[,.:;!-]*\s*(?:but|however|aber|pero|mais|mas|ma|maar)?\s*,?\s*)+")
_BUT = re.compile(r"^\s*(?:but|however),?\s*")
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS))
_GAP, _DOTS_RE, _BULLET_RE, _CODE_RE = re.compile(r"[^\w]+|_+"), re.compile(_DOTS), re.compile(_BULLET), re.compile(_CODE)
_EDGES = re.compile(r"^[\s(\[{<\"'*_-]+|[\s)\]}>\"'*_.!?…—–-]+$")
_CLOSED = re.compile(r"(?:[.!?。！？][)\]\"'”’»*_`]*|…[)\]\"'”’»*_`]+)\s*$")
_CUT_DOTS = re.compile(r"[^\W_](?:\.{3}|…)+\s*$")
_APOSTROPHES = str.maketrans("’‘`", "'''")


def folded(text: str) -> str:
    """Letters and digits in lower case, single blanks between words."""
    return _GAP.sub(" ", text.lower()).strip()


def votes(words: set[str]) -> list[int]:
    """How many different small words of each language there are."""
    out = [0] * len(LANGUAGES)
    for w in words:
        for k in LANGUAGES_OF.get(w, ()):
            out[k] += 1
    return out


@functools.lru_cache(maxsize=4096)
def _is_latin(c: str) -> bool:
    return unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN", "MODIFIER LETTER", "FEMININE", "MASCULINE"))


def scripts(text: str) -> tuple[int, int]:
    """Numbers of Latin and of other letters."""
    if text.isascii():
        return sum(map(str.isalpha, text)), 0
    latin = sum(c.isalpha() and (c.isascii() or _is_latin(c)) for c in text)
    return latin, sum(map(str.isalpha, text)) - latin


def copies(question: str, answer: str) -> bool:
    """Whether a folded answer says nothing beyond the folded question: labels and numbers around it count for nothing."""
    core = _NUMBER.sub("", _LABEL.sub("", question))
    if len(core) <= 8 or core not in answer:
        return False
    rest = _NUMBER.sub("", _LABEL.sub("", answer)).replace(core, " ")
    return not _REST.sub(" ", rest).strip()


def refuses(flat: str) -> bool:
    """Whether the first sentence, behind its openings, declines to answer."""
    low = flat.lower().translate(_APOSTROPHES)
    start = _BUT.sub("", _OPENING.sub("", low))
    first = start.split(". ", 1)[0]
    return not REFUSAL_WORDS.isdisjoint(re.findall(r"[\w']+", first)) and bool(_REFUSAL.search(first))


def other_language(question: str, answer: str, q_votes: list[int], a_votes: list[int]) -> bool:
    """Whether the answer is in another script or, by its small words, in another language than the question."""
    if not (question.isascii() and answer.isascii()):
        (ql, qo), (al, ao) = scripts(question), scripts(answer)
        if qo + ao and ((ql > 3 * qo and ao > 3 * al) or (qo > 3 * ql and al > 3 * ao and al > 8)):
            return True
    qn, an = max(q_votes), max(a_votes)
    own = q_votes.index(qn)
    return qn >= 2 and an >= 2 and own != a_votes.index(an) and an >= 2 * a_votes[own] + 1


def cut_short(answer: str) -> bool:
    """Whether an answer ends abruptly or leaves a delimiter open; what stands before closing dots is judged."""
    dotted = _DOTS_RE.search(answer)
    end = (answer[: dotted.start()] if dotted else answer).rstrip()
    last = end.rsplit("\n", 1)[-1].lstrip()
    ended = bool(_CLOSED.search(last)) or (not dotted and bool(_BULLET_RE.search(last))) or (bool(_CODE_RE.search(last)) and not _CUT_DOTS.search(answer))
    if not ended or answer.count("```") % 2 or answer.count("(") > answer.count(")"):
        return True
    return answer.count("[") > answer.count("]") and "[" in last and "]" not in last[last.rindex("[") :]


def defects_of(question: str | None, answer: str | None) -> list[str]:
    """Every defect of a pair, in the order of the rules."""
    q, a = question or "", answer or ""
    flat = " ".join("".join(c if c.isprintable() or c.isspace() else " " for c in a).split()) if not a.isascii() else " ".join(a.split())
    bare, fa = _EDGES.sub("", flat).strip().lower(), folded(flat)
    if not fa or not bare or bare in PLACEHOLDERS:
        return ["empty_answer"]
    fq = folded(q)
    out = []
    if copies(fq, fa):
        out.append("copies_question")
    if refuses(flat):
        out.append("refusal")
    if other_language(q, a, votes(set(fq.split())), votes(set(fa.split()))):
        out.append("other_language")
    if cut_short(a):
        out.append("truncated_answer")
    return out


def judge_pairs(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Add ``defects``: the array of every triggered defect type, in the order of the rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defects_of(q, a) for q, a in zip(b[question], b[answer], strict=True)]
            yield b.assign(defects=found)

    names = [c for c in df.columns if c != "defects"]
    return widened(df.select(*[f"`{c}`" for c in names])).mapInPandas(run, out_schema(df.select(*[f"`{c}`" for c in names]), defects="array<string>"))
