"""Broken prompt and response pairs (problem 1).

The defect of each pair, if any: empty, copied_question, refusal, other_language or truncated.

Languages are told apart by naive Bayes over the character n-grams of words; prompt and response are compared by the
posteriors of their sentences. Truncation is told by two n-gram likelihoods over the marks before a text's end (runs of
letters, digits and blanks as classes, punctuation as it is): that a sentence ends after them, learned from all places
inside the texts, and that a text ends after them, learned from the ends of all. A response declines if naive Bayes
over the words and pairs of words of its sentences finds some that decline and none that answers.

All models and thresholds are fitted from the sentences below and all pairs: one pass over the texts counts words by
language, marks in their contexts and features of sentences. Texts that figures don't settle are kept as numbers, over
which the model of declining is fitted in rounds. All sums are of integers, so that partitions make no difference, and
the driver only sees tables of bounded size.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialise

# A few sentences of each language, to start from.
SEED = {
    "en": "The court must decide the motion within ten days after the hearing. A party who files an answer shall serve a copy on the other party. "
    "What happens if the clerk does not record the order? How many days does the guardian have to appeal? Is a written notice required before the review? "
    "Can counsel withdraw the petition after service? Explain the steps and list the exceptions to the rule. Yes, under this rule they may, but it is not required.",
    "es": "El tribunal debe resolver la solicitud dentro de diez días después de la audiencia. La parte que presenta una respuesta entregará una copia a la otra parte. "
    "¿Qué pasa si la secretaría no registra la orden? ¿Cuántos días tiene el tutor para apelar? ¿Cuándo debe el abogado enviar el expediente? "
    "Explique cómo se puede retirar la petición; la niñez tiene derecho a una notificación por escrito, sin demora, conforme a la sección citada.",
    "fr": "Le tribunal doit statuer sur la requête dans les dix jours après l’audience. La partie qui dépose une réponse remet une copie à l’autre partie. "
    "Que se passe-t-il si le greffe n’enregistre pas l’ordonnance ? Combien de jours le tuteur a-t-il pour faire appel ? Est-ce que l’avocat peut retirer sa demande ? "
    "Quand faut-il un avis écrit, et qui le signe ? Selon la règle, cela n’est pas exigé, sauf préavis, lorsque la mère et l’enfant sont présents.",
    "de": "Das Gericht muss über den Antrag binnen zehn Tagen nach der Anhörung entscheiden. Wer eine Antwort einreicht, übermittelt der anderen Partei eine Abschrift. "
    "Was geschieht, wenn die Geschäftsstelle die Verfügung nicht einträgt? Wie viele Tage hat der Vormund für die Beschwerde? Darf man den Hilfeplan ändern? "
    "Erläutern Sie die Schritte und die Ausnahmen; gemäß dieser Vorschrift ist eine schriftliche Mitteilung nicht erforderlich, aber zulässig.",
    "pt": "O tribunal deve decidir o pedido no prazo de dez dias após a audiência. A parte que apresenta uma resposta entrega uma cópia à outra parte. "
    "O que acontece se a secretaria não registrar a ordem? Quantos dias tem o tutor para recorrer? Quando é que o cartório deve enviar o processo? "
    "Explique como se pode retirar a petição; a criança tem direito a uma notificação por escrito, sem demora, segundo o parágrafo e a decisão.",
    "pl": "Sąd musi rozpoznać wniosek w ciągu dziesięciu dni po rozprawie. Strona, która składa odpowiedź, doręcza odpis drugiej stronie. "
    "Co się stanie, jeżeli sekretarz nie zapisze postanowienia? Ile dni ma opiekun na odwołanie? Czy można wycofać pismo po doręczeniu? "
    "Kiedy wymagane jest pisemne zawiadomienie i kto je podpisuje? Zgodnie z przepisem nie jest to konieczne, ale świadek może się zgłosić.",
    "vi": "Tòa án phải quyết định đơn trong vòng mười ngày sau phiên họp. Bên nộp câu trả lời phải gửi bản sao cho bên kia. "
    "Điều gì xảy ra nếu thư ký không ghi lại lệnh? Người giám hộ có bao nhiêu ngày để kháng cáo? Khi nào cần thông báo bằng văn bản và ai ký? "
    "Hãy giải thích các bước và ngoại lệ; theo quy định, cơ quan có thể xem lại kế hoạch chăm sóc và trẻ có quyền được biết.",
    "ru": "Суд должен решить ходатайство в течение десяти дней после заседания. Сторона, которая подаёт ответ, направляет копию другой стороне. "
    "Что будет, если секретарь не запишет определение? Сколько дней у опекуна, чтобы обжаловать? Может ли адвокат отозвать заявление? "
    "Когда требуется письменное уведомление и кто его подписывает? По правилу это не обязательно, но допускается.",
    "zh": "法院应当在开庭后十日内就申请作出决定。提交答复的一方应当把副本送达另一方。如果书记员没有记录命令，会怎么样？监护人有多少天可以上诉？"
    "律师可以撤回申请书吗？请说明步骤和例外；依照规则，通知应当以书面形式作出，并抄送儿童。每个家庭可以在会议上查阅案卷。",
}
LANGUAGES = tuple(SEED)

# Short sentences that answer, to start from.
SEED_ANSWERS = """Yes, the clerk can do that. It depends on the county. The court may extend the time. The other party has to sign it. They must file it first. Only a lawyer can.
Sí, la secretaría puede hacerlo. Depende del condado. Oui, le greffe peut le faire. Cela dépend du comté. Ja, das kann die Geschäftsstelle tun. Das hängt vom Bezirk ab.
Sim, o cartório pode fazê-lo. Tak, sekretarz może to zrobić. Có, thư ký có thể làm điều đó. Да, секретарь может это сделать. 可以，书记员可以这样做。"""

# Sentences that decline, or go with such, to start from.
SEED_DECLINES = """I'm sorry, but I can't help with that. I am unable to answer this question. I cannot answer that. The sources do not say. The passages do not contain
enough information. The documents do not mention this. There is no information on this in the context. This is not covered by the text. It cannot be determined from
the sources. I could not find anything about it. I would rather not say. I don't know. That is beyond what I can discuss. My sources are silent on this. Please
consult a lawyer. Let me know if I can help with anything else. You may want to contact the clerk.
Lo siento, no puedo ayudar con eso. Las fuentes no dicen nada sobre esto. Las reglas no responden a esta pregunta. No se puede responder. No lo sé. Consulte a un abogado.
Je suis désolé, je ne peux pas répondre. Les règles ne répondent pas à cette question. Les sources ne disent rien à ce sujet. Je ne sais pas. Veuillez consulter un avocat.
Es tut mir leid, das kann ich leider nicht beantworten. Die Vorschriften beantworten diese Frage nicht. Die Quellen sagen dazu nichts. Das weiß ich nicht. Bitte wenden Sie sich an einen Anwalt.
Desculpe, não posso responder a isso. As regras não respondem a esta pergunta. As fontes não dizem nada sobre isto. Não sei. Consulte um advogado.
Przykro mi, nie mogę odpowiedzieć na to pytanie. Źródła nic o tym nie mówią. Nie wiem. Proszę zapytać prawnika.
Xin lỗi, tôi không thể trả lời câu hỏi này. Các nguồn không nói gì về điều này. Tôi không biết.
К сожалению, я не могу ответить на этот вопрос. В источниках об этом ничего не сказано. Я не знаю. Обратитесь к адвокату.
抱歉，我无法回答这个问题。 资料中没有提到这一点。 我不知道。 请咨询律师。"""

INVISIBLE = re.compile(r"[\u0000-\u0008\u000b-\u001f\u007f-\u009f­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯⠀ㅤ︀-️﻿ﾠ]")
TAGS = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
PLACEHOLDER = re.compile(
    r"(?:n\.?/?a\.?|tbd|tba|tbc|todo|none|null|nil|nan|undefined|empty|blank|pending|placeholder|no answer|no response|not available|not applicable|answer|response|xxx+|lorem ipsum|"
    r"sin respuesta|sans réponse|keine antwort|sem resposta|brak odpowiedzi|нет ответа|无|暂无)"
)
MANY_WORDS = re.compile(r"[A-Za-z]{2,}\W+(?:\w+\W+){6}")

QUOTED = re.compile(r"\"[^\"]{3,}\"|“[^”]{3,}”|«[^»]{3,}»|„[^“”]{3,}[“”]|「[^」]{3,}」|(?m:^\s*>.*$)")
LETTERS = re.compile(r"[^\W\d_]+")
WIDE = re.compile(r"[⺀-鿿豈-﫿]")
LINE = "\ue000"  # stands for a line end among the tokens

LABEL = re.compile(
    r"^(?:\W|_)*(?:(?:the|your) question (?:is|was|asks)|you (?:ask|asked)|question|query|prompt|asked|user|q|answer|response|a|re|pregunta|respuesta|question posée|réponse|frage|antwort|pergunta|resposta|pytanie|odpowiedź|вопрос|ответ|问题|问|答|câu hỏi|trả lời)\s*[:：.\-–]\s*",
    re.I,
)
END_LABEL = re.compile(r"(?:\W|_)*\b(?:answer|response|respuesta|réponse|antwort|resposta|odpowiedź|ответ|答)\s*[:：]?\s*$", re.I)

SOURCE_LINE = re.compile(r"[ \t]*[(*_]*(?:sources?|see|cite|citations?|fuentes?|quellen?|fontes?|źródło|источник|来源|nguồn)[*_]*\s*[:：]\s*(?P<cited>[^\n]*)$", re.I)
FULL_CITATION = re.compile(r"(?:[A-Z]{2,5}\s*)?(?:§+\s*)?\d+[.-]\d{2,}(?:\([A-Za-z0-9]{1,4}\))*(?:\s*[,;]\s*(?:[A-Z]{2,5}\s*)?\d+[.-]\d{2,}(?:\([A-Za-z0-9]{1,4}\))*)*[.)]?|(?:\[\d+\])+\.?|https?://\S+|[^\n]*[.!?]")
MARKS = re.compile(r"\s*(?:\[\d+(?:\s*[,;–-]\s*\d+)*\]|\(\s*(?:see\s+)?[A-Z]{2,5}\s*\d+\.\d{2,}(?:\([A-Za-z0-9]{1,4}\))*\s*\))$")

END_OF_TEXT = "\ue001"

CONTEXT = 4  # marks
SLOTS = 1 << 16  # of the counts of contexts, and of the features of declining
GRAM_SLOTS = 1 << 20  # of the n-grams of words
UNIT = 1 << 16  # weights are summed as integers of this unit
SURE = 2.0  # log odds
TEMPER = 0.3  # n-grams overlap, so the likelihoods that naive Bayes multiplies are no independent ones


class Language:
    """Naive Bayes over the character n-grams (1 to 3) of words, and longer words themselves."""

    def __init__(self, texts: dict[str, Counter]):
        """texts: counts of words by language; how many words of it were seen is a language's prior."""
        self._fit(*count_grams((i, w, n) for i, lang in enumerate(LANGUAGES) for w, n in texts[lang].items()))

    @classmethod
    def of_counts(cls, slots: np.ndarray, weights: np.ndarray, words: np.ndarray) -> Language:
        """slots, weights, words: as of count_grams()."""
        model = cls.__new__(cls)
        model._fit(slots, weights, words)
        return model

    def _fit(self, slots: np.ndarray, weights: np.ndarray, words: np.ndarray) -> None:
        rest = -np.log(weights.sum(axis=0) / UNIT + len(slots) * 0.1 + 1e-9)
        self.table = np.concatenate([[np.log(0.1) + rest], np.log(weights / UNIT + 0.1) + rest]).astype(np.float32)
        self.row = np.zeros(GRAM_SLOTS, dtype=np.int32)  # 0: n-grams never seen
        self.row[slots] = np.arange(1, len(slots) + 1)
        share = words + 1.0
        self.prior = np.log(share / share.sum())

    @staticmethod
    def grams(word: str) -> list[int]:
        """The slots of a word's n-grams."""
        w = f" {word} "
        every = [w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1) if w[i : i + k] != " "] + ([w] if len(w) > 5 else [])
        return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % GRAM_SLOTS for g in every]

    def word(self, word: str) -> np.ndarray:
        return self.table[self.row[self.grams(word)]].sum(axis=0, dtype=float)

    def language_of(self, text: str) -> str:
        """The likeliest language of a text, read as one sentence."""
        words = LETTERS.findall(text.lower())
        return LANGUAGES[int(self.posteriors(np.sum([self.word(w) for w in words], axis=0)[None])[0].argmax())]

    def posteriors(self, likelihoods: np.ndarray) -> np.ndarray:
        """Probabilities of LANGUAGES from sums of word()."""
        v = TEMPER * likelihoods + self.prior
        p = np.exp(v - v.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def count_grams(words: Iterator[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (language, word, how often): slots of n-grams, their weights by language in UNITs, words seen by language."""
    seen, slots, sizes, langs, weights = np.zeros(len(LANGUAGES), dtype=np.int64), [], [], [], []
    for lang, word, n in words:
        g = Language.grams(word)
        slots += g
        sizes.append(len(g))
        langs.append(lang)
        weights.append(round(n**0.75 * UNIT))  # one long text must not outweigh the others
        seen[lang] += n
    key, at = np.unique(np.array(slots, dtype=np.int64), return_inverse=True)
    out = np.zeros((len(key), len(LANGUAGES)), dtype=np.int64)
    np.add.at(out, (at, np.repeat(np.array(langs, dtype=np.int64), sizes)), np.repeat(np.array(weights, dtype=np.int64), sizes))
    return key, out, seen


class Tokens:
    """What the tokens of texts (by white space) say, worked out once a token: word likelihoods, letters, marks."""

    def __init__(self, language: Language, keep: int = 200_000):
        self.language, self.keep = language, keep
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.words: list[list[str]] = []
        self.done = 0
        self.likelihood = np.zeros((0, len(LANGUAGES)))
        self.facts = np.zeros((0, 5), dtype=np.int64)

    def _new(self, token: str) -> int:
        words = [] if any(c.isdigit() for c in token) or (token.isupper() and 2 <= len(token.strip(".,;:()")) <= 5) else LETTERS.findall(token.lower())
        self.words.append(words)
        letters = sum(map(len, words)) * (3 if WIDE.search(token) else 1)  # an ideograph stands for about as much
        ends = token == LINE or token.rstrip("\"'”’»)]*_`」")[-1:] in (".", "!", "?", ":", "。", "！", "？", "：")
        v = np.sum([self.language.word(w) for w in words], axis=0) if words else np.zeros(len(LANGUAGES))
        digit = any(c.isdigit() for c in token)
        key = "9" if digit else "".join(words) or token[:8]
        self.rows.append((v, letters, ends, digit, zlib.crc32(key.encode("utf-8", "surrogatepass")), len(words)))
        self.ids[token] = len(self.rows) - 1
        return len(self.rows) - 1

    def sentences(self, texts: list[str]) -> Sentences:
        if len(self.ids) > self.keep:
            self._clear()
        flat: list[int] = []
        n = np.empty(len(texts), dtype=np.int64)
        get, new = self.ids.get, self._new
        for i, t in enumerate(texts):
            if WIDE.search(t):  # unspaced scripts: each sentence a token
                t = re.sub(r"(?<=[。！？；，：])", " ", t)
            words = (t.replace("\n", f" {LINE} ") if "\n" in t else t).split()
            row = [get(w, -1) for w in words]
            if -1 in row:
                row = [k if (k := get(w, -1)) >= 0 else new(w) for w in words]
            flat += row
            n[i] = len(row)
        if self.done < len(self.rows):
            fresh = self.rows[self.done :]
            self.likelihood = np.concatenate([self.likelihood, np.array([r[0] for r in fresh])])
            self.facts = np.concatenate([self.facts, np.array([r[1:] for r in fresh], dtype=np.int64)])
            self.done = len(self.rows)
            self.rows[:] = [()] * self.done
        return Sentences(self, np.array(flat, dtype=np.int64), n)


class Sentences:
    """The sentences of some texts: the text of each, its letters, words, figures, likelihoods and features."""

    def __init__(self, tokens: Tokens, ids: np.ndarray, n: np.ndarray):
        self.ids = ids
        owner = np.repeat(np.arange(len(n)), n)
        letters, ends, digit, hashed, words = tokens.facts[ids].T if len(ids) else np.zeros((5, 0), dtype=np.int64)
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (owner[1:] != owner[:-1]) | (ends[:-1] > 0)
        at = np.flatnonzero(first)
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
        self.owner, self.letters, self.words, self.digits = owner[at], add(letters), add(words), add(digit)
        self.likelihood = np.add.reduceat(tokens.likelihood[ids], at, axis=0) if len(at) else np.zeros((0, len(LANGUAGES)))
        # features: words, pairs of words, whether there are figures, and how long the sentence is
        of = np.cumsum(first) - 1
        pair = np.flatnonzero(~first)
        long = np.digitize(self.words, (3, 5, 8, 12, 20))
        self.feature = np.concatenate([hashed % SLOTS, (hashed[pair] * 31 + hashed[pair - 1] * 1_000_003 + 7) % SLOTS, (np.minimum(self.digits, 1) * 6 + long) * 7919 % SLOTS])
        self.of = np.concatenate([of, of[pair], np.arange(len(at))])

    def sums(self, values: np.ndarray, texts: int) -> np.ndarray:
        return np.bincount(self.owner, values, minlength=texts)


class Declining:
    """Naive Bayes over the features of sentences: log odds that one declines."""

    def __init__(self, yes: np.ndarray, no: np.ndarray, prior: float = 0.05):
        """yes, no: (SLOTS + 1), how often each feature is seen in sentences that decline and in others, and how many of these there are."""
        share = lambda x: np.log(x[:SLOTS] + 0.05) - np.log(x[SLOTS] + 1)
        self.odds = (share(yes) - share(no)).astype(np.float32)
        self.prior = float(np.log(prior / (1 - prior)))

    def of(self, s: Sentences) -> np.ndarray:
        n = np.bincount(s.of, minlength=len(s.owner))
        return self.prior + np.bincount(s.of, self.odds[s.feature], minlength=len(s.owner)) / np.sqrt(np.maximum(n, 1))

    def refusals(self, s: Sentences, texts: int, sure: float = SURE) -> np.ndarray:
        """Texts of which some sentence surely declines and none answers; one of figures answers, one of a word or two says nothing."""
        odds = self.of(s)
        tells = (s.words >= 3) | (s.digits > 0) & (s.words > 0)
        answers = s.sums(tells & ((odds < 0) | (s.digits > 0)), texts)
        return (s.sums((odds >= sure) & (s.words >= 2) & (s.digits == 0), texts) > 0) & (answers == 0)


def spoken(text: str | None) -> str:
    """A text without quotations and tags, which are not its own words."""
    t = text or ""
    if "<" in t:
        t = TAGS.sub(" ", t)
    return QUOTED.sub(" ", t) if any(c in t for c in '"“«„「>') else t


def seed_words() -> dict[str, Counter]:
    return {lang: Counter(LETTERS.findall(text.lower())) for lang, text in SEED.items()}


def seed_language() -> Language:
    """A model of the seed alone, to which no language is likelier than another."""
    model = Language(seed_words())
    model.prior = np.zeros(len(LANGUAGES))
    return model


SEED_WEIGHT = 5  # of its words and marks
SEED_TEXTS = 6_000  # its sentences on declining count 10 times each, and beyond so many texts in proportion to them


def sure_words(tokens: Tokens, s: Sentences) -> Counter:
    """Counts of (language, word) in the sentences of whose language the model of the tokens is sure."""
    out: Counter = Counter()
    if not len(s.ids):
        return out
    p = tokens.language.posteriors(s.likelihood)
    of = s.of[: len(s.ids)]
    keep = (p.max(axis=1) > 0.99)[of]
    key, n = np.unique(p.argmax(axis=1)[of][keep] * len(tokens.ids) + s.ids[keep], return_counts=True)
    for k, times in zip(key.tolist(), n.tolist(), strict=True):
        lang, token = divmod(k, len(tokens.ids))
        for w in tokens.words[token]:
            out[lang, w] += times
    return out


def fit_language(texts: list[str]) -> Language:
    """A model from the seed and from the sentences of texts, each labelled by the seed's model if it is sure."""
    words = {lang: Counter({w: SEED_WEIGHT * n for w, n in c.items()}) for lang, c in seed_words().items()}
    tokens = Tokens(seed_language())
    for (lang, w), n in sure_words(tokens, tokens.sentences([spoken(t) for t in texts])).items():
        words[LANGUAGES[lang]][w] += n
    return Language(words)


class Undecided:
    """Texts in which no sentence answers by its figures, as numbers: what is needed to judge them by one model after the other."""

    TYPES = (np.uint16, np.int32, np.uint8, np.int32, np.int8, np.bool_)

    def __init__(self, *parts: np.ndarray):
        """Features; of each sentence how many of them it has, and its words (3: or more); of each text its sentences, what is recorded (1 refused, -1 not, 0 nothing), and whether it has figures."""
        self.parts = parts
        self.features, self.sizes, self.words, self.sentences, self.recorded, self.figures = parts
        self.owner = np.repeat(np.arange(len(self.sentences)), self.sentences)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def pack(self) -> bytes:
        sizes = np.array([len(self.features), len(self.sizes), len(self.sentences)], dtype=np.int64)
        return sizes.tobytes() + b"".join(p.astype(k).tobytes() for p, k in zip(self.parts, self.TYPES, strict=True))

    @classmethod
    def unpack(cls, data: bytes) -> Undecided:
        f, s, n = np.frombuffer(data, np.int64, 3).tolist()
        parts, at = [], 24
        for size, kind in zip((f, s, s, n, n, n), cls.TYPES, strict=True):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(*parts)

    def judge(self, model: Declining) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each sentence that it declines, whether each text does)."""
        odds = model.prior + np.bincount(self.of, model.odds[self.features], minlength=len(self.sizes)) / np.sqrt(np.maximum(self.sizes, 1))
        some, answers = (np.bincount(self.owner[x], minlength=len(self.sentences)) > 0 for x in ((odds >= 0) & (self.words >= 2), (odds < 0) & (self.words >= 3)))
        return odds, some & ~answers

    def rates(self, model: Declining) -> np.ndarray:
        """(2, 2): texts recorded as refused, and as not, that by the model don't decline and do."""
        declines = self.judge(model)[1]
        return np.array([[((self.recorded == r) & (declines == d)).sum() for d in (False, True)] for r in (1, -1)], dtype=np.int64)

    def weights(self, model: Declining, told: np.ndarray) -> np.ndarray:
        """(SLOTS + 1): how much each feature stands in sentences that decline, and how many sentences do, in UNITs. told: log odds by what is recorded."""
        odds, declines = self.judge(model)
        p = 1 / (1 + np.exp(-np.clip(odds + told[self.recorded][self.owner], -30, 30)))
        p = np.round(np.where((declines & ~self.figures)[self.owner], p, 0.0) * UNIT)
        return np.append(np.bincount(self.features, p[self.of], minlength=SLOTS), p.sum()).astype(np.int64)


def declining_counts(s: Sentences, recorded: np.ndarray) -> tuple[np.ndarray, Undecided]:
    """What is to be known of some texts' sentences to fit a model of declining, and those texts that are undecided.

    (SLOTS + 2, 3): how often each feature is seen, in texts without figures that are recorded as refused, and in
    others without figures; the same of sentences; texts not undecided that are recorded as refused, and as not, and all texts.
    """
    n = len(recorded)
    figures = s.sums(s.digits, n) > 0
    settled = (s.sums((s.digits > 0) & (s.words > 0), n) > 0) | (s.sums(s.words >= 0, n) == 0)
    out = np.zeros((SLOTS + 2, 3), dtype=np.int64)
    plain, refused = ~figures[s.owner], (recorded > 0)[s.owner]
    for j, flag in enumerate((np.ones(len(s.owner), dtype=bool), plain & refused, plain & ~refused)):
        out[:SLOTS, j] = np.bincount(s.feature[flag[s.of]], minlength=SLOTS)
        out[SLOTS, j] = flag.sum()
    out[SLOTS + 1] = (settled & (recorded > 0)).sum(), (settled & (recorded < 0)).sum(), n
    keep = ~settled[s.owner]
    chosen = np.flatnonzero(keep[s.of])
    chosen = chosen[np.argsort(s.of[chosen], kind="stable")]
    sizes, sentences = np.bincount(s.of[chosen], minlength=len(s.owner))[keep], np.bincount(s.owner, minlength=n)[~settled]
    return out, Undecided(s.feature[chosen], sizes, np.minimum(s.words[keep], 3), sentences, recorded[~settled], figures[~settled])


def learn_declining(counts: np.ndarray, rates: Callable[[Declining], np.ndarray], weights: Callable[[Declining, np.ndarray], np.ndarray], rounds: int = 4) -> Declining:
    """A model from the seed and texts of which declining_counts(), and over the undecided ones rates() and weights(), are given.

    The record may be wrong in many rows: it only is where the labels begin. A sentence is first held to decline if its
    text is recorded as refused and has no figures; then by the model of the round before, if nothing else in its text answers.
    The seed keeps its weight beside any number of texts: short sound answers would else come to decline by themselves.
    """
    every, (refused, sound, texts) = counts[: SLOTS + 1], counts[SLOTS + 1]
    weight = 10.0 * max(1.0, texts / SEED_TEXTS)
    fixed = [(t, 1.0) for t in SEED_DECLINES.split("\n")] + [(t, 0.0) for t in (*SEED_ANSWERS.split("\n"), *SEED.values())]
    s = Tokens(seed_language()).sentences([t for t, _ in fixed])
    known = weight * np.array([w for _, w in fixed])[s.owner]
    seed = [np.append(np.bincount(s.feature, w[s.of], minlength=SLOTS), w.sum()) for w in (known, weight - known)]
    fit = lambda yes: Declining(seed[0] + yes, seed[1] + every[:, 0] - yes)
    model = fit(0.8 * every[:, 1] + 0.02 * every[:, 2])
    for _ in range(rounds):
        # how much the record tells, by the model so far
        n = rates(model)
        n[:, 0] += refused, sound
        rate = np.clip(n[0] / np.maximum(1, n.sum(axis=0)), 0.01, 0.99)
        told = np.array([0.0, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))])  # -1 is the last
        model = fit(weights(model, told) / UNIT)
    return model


def fit_declining(tokens: Tokens, texts: list[tuple[str | None, bool | None]], rounds: int = 4) -> Declining:
    """A model from the seed and (response, whether it is recorded as refused)."""
    rows = [(spoken(a), r) for a, r in texts if a]
    counts, undecided = declining_counts(tokens.sentences([a for a, _ in rows]), np.array([0 if r is None else 1 if r else -1 for _, r in rows], dtype=np.int8))
    return learn_declining(counts, undecided.rates, undecided.weights, rounds)


# Classes of marks. Quotation marks and brackets that close are left out after a mark, as what they close has ended.
LETTER, CAPITAL, WIDE_LETTER, DIGIT, LINE_END, BLANK, DOT, OTHER, STOP = range(9)
CAPITALS, CAPITALISED, DOTS, ITEM, END, LONE = 10, 11, 12, 13, 14, 15
KEPT = {c: 16 + i for i, c in enumerate(",;:!?'\"()[]{}|-*_`#>/\\&%$§@+=~。，；：？！")}
ALIKE = {"“": '"', "”": '"', "«": '"', "»": '"', "„": '"', "’": "'", "‘": "'", "–": "-", "—": "-", "（": "(", "）": ")"}
SKIPPED = np.array([KEPT[c] for c in "'\")]*_`"])


class Marks:
    """The marks of texts, as numbers."""

    def __init__(self):
        self.kind = np.full(0x110000, 255, dtype=np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.kind[points] == 255]).tolist():
            c = ALIKE.get(chr(p), chr(p))
            cat = unicodedata.category(c)
            if c == END_OF_TEXT:
                k = END
            elif c in KEPT:
                k = KEPT[c]
            elif c in "\n\r":
                k = LINE_END
            elif c.isspace() or cat in ("Cc", "Cf", "Zs"):
                k = BLANK
            elif c in ".…":
                k = DOT if c == "." else DOTS
            elif WIDE.match(c):
                k = WIDE_LETTER
            elif cat[0] in "LM":
                k = CAPITAL if cat in ("Lu", "Lt") else LETTER
            else:
                k = DIGIT if cat[0] == "N" else OTHER
            self.kind[p] = k

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marks of all texts, one END after each text; the place of each END)."""
        a = np.frombuffer((END_OF_TEXT.join(t.replace(END_OF_TEXT, " ") for t in texts) + END_OF_TEXT).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._learn(a)
        k = self.kind[a]
        group = np.where(k == CAPITAL, LETTER, np.where(k == LINE_END, BLANK, np.where(k == DOTS, DOT, k)))
        first = np.ones(len(k), dtype=bool)
        first[1:] = (group[1:] != group[:-1]) | ~np.isin(group[1:], (LETTER, WIDE_LETTER, DIGIT, BLANK, DOT))
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(k)))
        m = k[at].astype(np.int64)
        capitals, lines, dots = (np.add.reduceat((k == x).astype(np.int64), at) for x in (CAPITAL, LINE_END, DOTS))
        letter = group[at] == LETTER
        m[letter] = np.where(capitals == size, np.where(size > 1, CAPITALS, LONE), np.where(k[at] == CAPITAL, CAPITALISED, LETTER))[letter]
        m[(group[at] == BLANK) & (lines > 0)] = LINE_END
        m[(group[at] == BLANK) & (lines == 0)] = BLANK
        m[(group[at] == DOT) & ((size > 1) | (dots > 0))] = DOTS
        # a line end with the sign of a list's item is one mark: what follows is no new sentence but the item itself
        n = len(m)
        nxt = lambda d: np.append(m[d:], np.full(min(d, n), END))[:n]
        gap = lambda x: (x == BLANK) | (x == END)
        numbered = (m == LINE_END) & np.isin(nxt(1), (DIGIT, LETTER, LONE)) & np.isin(nxt(2), (DOT, KEPT[")"])) & gap(nxt(3)) & (np.append(size[1:], 9)[:n] <= 3)
        bullet = (m == LINE_END) & np.isin(nxt(1), (KEPT["-"], KEPT["*"], OTHER)) & gap(nxt(2))
        drop = np.zeros(n, dtype=bool)
        for flag, width in ((numbered, 3), (bullet, 2)):
            for i in np.flatnonzero(flag).tolist():
                m[i] = ITEM
                last = i + width
                drop[i + 1 : last + (last < n and m[last] == BLANK)] = True
        # what closes after a mark is left out
        before = np.append(END, m[:-1])
        drop |= np.isin(m, SKIPPED) & np.isin(before, (DOT, KEPT["!"], KEPT["?"], KEPT["。"], KEPT["！"], KEPT["？"]))
        m = m[~drop]
        return m, np.flatnonzero(m == END)


def contexts(m: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(marks, CONTEXT) slots of the last 1 to CONTEXT marks up to each; marks of another text count as none."""
    begin = np.zeros(len(m), dtype=np.int64)
    begin[ends[:-1] + 1] = ends[:-1] + 1
    begin = np.maximum.accumulate(begin)
    same = np.where((m == CAPITALISED) | (m == LONE), LETTER, m).astype(np.uint64) + np.uint64(1)
    h, out = np.zeros(len(m), dtype=np.uint64), []
    place = np.arange(len(m))
    for k in range(CONTEXT):
        back = np.zeros(len(m), dtype=np.uint64)
        back[k:] = same[: len(m) - k]
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(place - k >= begin, back, np.uint64(0)) + np.uint64(k + 1)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(48)).astype(np.int64))
    return np.stack(out, axis=1)


def outcomes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each mark whether it tells something, whether a sentence ends after it inside a text, and whether the text ends after it.

    A capital alone may begin a sentence, and may be a pronoun or an initial: it tells nothing.
    """
    one, two = np.append(m[1:], END), np.append(m[2:], [END, END])[: len(m)]
    starts = np.isin(two, (CAPITALISED, WIDE_LETTER, KEPT['"'], KEPT["["], KEPT["("]))
    return (m != END) & ~((one == BLANK) & (two == LONE)), (one == LINE_END) | (one == BLANK) & starts | (m == KEPT["。"]) & (one != END), one == END


def tail_of(text: str) -> str:
    """A text without a complete source line and the citation marks at its end."""
    t = text.rstrip()
    at = t.rfind("\n")
    m = SOURCE_LINE.match(t[at + 1 :])
    if m and FULL_CITATION.fullmatch(m["cited"].strip()):
        t = t[: max(at, 0)].rstrip()
    while t[-1:] in ("]", ")") and (m := MARKS.search(t[-120:])):
        t = t[: len(t) - len(m[0])].rstrip()
    return t


def context_keys(texts: list[str | None], marks: Marks | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, each the slots of its last 1 to CONTEXT marks in one number, and (contexts, 3) how often each is followed inside a text, there by a new sentence, and by the text's end."""
    m, ends = (marks or Marks())([tail_of(t) for t in texts if t and not t.isspace()])
    tells, sentence, text = outcomes(m)
    slot = contexts(m, ends)[tells].astype(np.uint64)
    key = np.zeros(len(slot), dtype=np.uint64)
    for k in range(CONTEXT):
        key |= slot[:, k] << np.uint64(16 * k)
    return sums_by(key.view(np.int64), np.stack([~text, sentence, text], axis=1)[tells])


def sums_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows of counts."""
    key, at = np.unique(keys, return_inverse=True)
    return key, np.stack([np.bincount(at, counts[:, j], minlength=len(key)) for j in range(counts.shape[1])], axis=1).astype(np.int64)


def slots_of(keys: np.ndarray) -> np.ndarray:
    """(contexts, CONTEXT) slots."""
    return np.stack([(keys.view(np.uint64) >> np.uint64(16 * k)) & np.uint64(SLOTS - 1) for k in range(CONTEXT)], axis=1).astype(np.int64)


def by_slot(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(slots, 3): the counts of contexts() summed by the slots of each length."""
    out, slot = np.zeros((SLOTS, 3), dtype=np.int64), slots_of(keys)
    for k in range(CONTEXT):
        np.add.at(out, slot[:, k], counts)
    return out


def count_contexts(texts: list[str | None], marks: Marks | None = None) -> np.ndarray:
    """(slots, 3): how often each context of up to CONTEXT marks is followed inside a text, there by a new sentence, and by the text's end."""
    return by_slot(*context_keys(texts, marks))


def seed_counts() -> np.ndarray:
    """Counts of the seed's texts and sentences, so that there is something to go by for a few pairs."""
    return SEED_WEIGHT * count_contexts([*SEED.values(), *(s for t in SEED.values() for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", t))])


class Ending:
    """How likely a sentence, and a text, ends after given marks."""

    def __init__(self, counts: np.ndarray, weight: float = 10.0):
        goes_on, sentence, text = counts.astype(float).T
        self.weight, self.goes_on, self.sentence, self.text = weight, goes_on, sentence, text
        places = max(1.0, goes_on.sum() / CONTEXT)
        self.any_sentence = (sentence.sum() / CONTEXT) / places
        self.any_text = max(text.sum() / CONTEXT, 1.0) / max(1.0, places + text.sum() / CONTEXT)

    def _likelihood(self, slots: np.ndarray, hits: np.ndarray, places: np.ndarray, p: float) -> np.ndarray:
        out = np.full(len(slots), p)
        for k in range(CONTEXT):  # each longer context is smoothed by the shorter one
            out = (hits[slots[:, k]] + self.weight * out) / (places[slots[:, k]] + self.weight)
        return out

    def sentence_ends(self, slots: np.ndarray) -> np.ndarray:
        return self._likelihood(slots, self.sentence, self.goes_on, self.any_sentence)

    def text_ends(self, slots: np.ndarray) -> np.ndarray:
        """How many times likelier a text ends here than anywhere."""
        return self._likelihood(slots, self.text, self.goes_on + self.text, self.any_text) / self.any_text

    def thresholds(self, keys: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
        """Below which likelihoods a text is cut off, from context_keys() of all texts.

        Of a sentence's end: what parts the ends of sentences inside texts from other places there with the fewest
        errors. Of a text's end: halfway, in powers, between anywhere and where texts usually end.
        """
        inside, yes, text = counts.T
        if not text.any():
            return 0.5, 1.0
        slots = slots_of(keys)
        grid = np.linspace(0.02, 0.9, 89)
        p = self.sentence_ends(slots)
        order = np.argsort(p, kind="stable")
        below = lambda n: np.append(0, np.cumsum(n[order]))[np.searchsorted(p[order], grid)]
        no = inside - yes
        wrong = below(yes) + no.sum() - below(no)
        best = grid[wrong <= wrong.min() * 1.02]
        at = self.text_ends(slots)
        order = np.argsort(at, kind="stable")
        until = np.cumsum(text[order])
        usual = np.mean([at[order[np.searchsorted(until, i, side="right")]] for i in ((until[-1] - 1) // 2, until[-1] // 2)])  # the median
        return float(best[len(best) // 2]), float(np.sqrt(max(1.0, usual)))


def unfinished(text: str) -> bool:
    """Whether a quotation, bracket, code block, list or table is left open."""
    t = text.rstrip()
    line = t[t.rfind("\n") + 1 :].strip()
    if t.count('"') % 2 and re.sub(r"(?<=\d)\"", "", t).count('"') % 2:
        return True
    if t.count("“") > t.count("”") or t.count("«") > t.count("»") or t.count("```") % 2:
        return True
    if line.startswith("|") and not line.endswith("|") or re.fullmatch(r"(?:\d{1,3}|[A-Za-z])[.)]|[-*•–]|[-*•]\s*\S{0,2}", line):
        return True
    opened = sum(t.count(c) for c in "([{（")
    if opened and (opened != sum(t.count(c) for c in ")]}）") or t.rfind("(") > t.rfind(")") or t.rfind("[") > t.rfind("]")):
        depth = 0
        for c in re.sub(r"(?m)^\s*(?:\(?\w{1,3}\)|[:;]-?\))\s|[^()\[\]{}（）\n]+", " ", t):
            depth = max(0, depth + (c in "([{（") - (c in ")]}）"))
        return depth > 0
    return False


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if "<" not in answer and "&" not in answer and MANY_WORDS.search(answer):
        return False
    t = INVISIBLE.sub("", TAGS.sub(" ", html.unescape(answer))).strip()
    core = re.sub(r"[\s\W_]+", " ", t).strip().lower()
    return not core or PLACEHOLDER.fullmatch(re.sub(r"^[\s\W_]+|[\s\W_]+$", "", t).lower()) is not None or PLACEHOLDER.fullmatch(core) is not None


TOKEN = re.compile(r"[⺀-鿿]|[^\W_]+(?:[.(][^\W_]+\)?)*")  # a citation is one


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question again: relabelled, repeated or slightly changed."""
    if not question:
        return False
    low = question.lower()
    if not WIDE.search(low):
        # most of a copy's words are the question's; what punctuation does to some of them does not matter here
        words, have = answer.lower().split(), set(low.split())
        if len(words) > 12 and sum(w in have for w in words) < 0.4 * len(words):
            return False
    body = END_LABEL.sub("", TAGS.sub(" ", answer))
    for _ in range(3):
        shorter = LABEL.sub("", body, count=1)
        if shorter == body:
            break
        body = shorter
    q, a = TOKEN.findall(low), TOKEN.findall(body.lower())
    if not q or not a or len(a) < 0.6 * len(q):
        return False
    have = Counter(q)
    if sum(min(n, have[w] * -(-len(a) // len(q))) for w, n in Counter(a).items()) < 0.8 * len(a):
        return False
    if len(a) > 4 * len(q) + 8:
        # one repeat after the other, each from where the last one's match ends: linear in the number of repeats
        match, at, same = difflib.SequenceMatcher(None, [], q, autojunk=False), 0, 0
        while at < len(a):
            match.set_seq1(a[at : at + len(q) + max(2, len(q) // 4)])
            blocks = match.get_matching_blocks()[:-1]
            same += sum(m.size for m in blocks)
            at += blocks[-1].a + blocks[-1].size if blocks else len(q)
        return same >= 0.8 * len(a)
    again = q * max(1, round(len(a) / len(q)))
    same = sum(m.size for m in difflib.SequenceMatcher(None, again, a, autojunk=False).get_matching_blocks())
    return same >= 0.8 * len(a) and same >= 0.7 * len(again)


class Judge:
    """The defects of pairs, many at a time."""

    def __init__(self, language: Language, declining: Declining, ending: Ending, least: tuple[float, float]):
        self.language, self.declining, self.ending, self.least = language, declining, ending, least
        self.tokens, self.marks = Tokens(language), Marks()

    def __call__(self, questions: list[str | None], answers: list[str | None]) -> list[str | None]:
        out: list[str | None] = ["empty" if is_empty(a) else "copied_question" if is_copy(q, a) else None for q, a in zip(questions, answers, strict=True)]
        rest = [i for i, d in enumerate(out) if d is None]
        if not rest:
            return out
        asked = [spoken(questions[i]) for i in rest]
        asked = [a if LETTERS.search(a) else questions[i] or "" for a, i in zip(asked, rest, strict=True)]
        q, a = self.tokens.sentences(asked), self.tokens.sentences([spoken(answers[i]) for i in rest])
        refused = self.declining.refusals(a, len(rest))
        # a response's letters by how likely their sentence is in the prompt's language, all languages of both weighed
        prompt = np.zeros((len(rest), len(LANGUAGES)))
        np.add.at(prompt, q.owner, q.likelihood)
        known = q.sums(q.letters, len(rest)) > 0
        same = (self.language.posteriors(prompt)[a.owner] * self.language.posteriors(a.likelihood)).sum(axis=1)
        foreign = known & (a.sums(a.letters * (1 - same), len(rest)) > a.sums(a.letters * same, len(rest)))
        tails = [tail_of(answers[i]) for i in rest]
        m, ends = self.marks([t or "." for t in tails])
        slots = contexts(m, ends)[np.maximum(ends - 1, 0)]
        broken = (self.ending.sentence_ends(slots) < self.least[0]) | (self.ending.text_ends(slots) < self.least[1])
        for j, i in enumerate(rest):
            if refused[j]:
                out[i] = "refusal"
            elif foreign[j]:
                out[i] = "other_language"
            elif tails[j] and (unfinished(tails[j]) or (broken[j] and not TABLE_END.search(tails[j][-2000:]))):
                out[i] = "truncated"
        return out


TABLE_END = re.compile(r"(?:^|\n)[ \t]*\|[^\n]*\|[ \t]*$")


EVIDENCE = "kind string, key long, word string, a long, b long, c long, texts binary"
KEEP = 200_000  # counts that a task holds before it passes them on


def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EVIDENCE of (question, answer, refused): words by language, contexts of marks, features of sentences; undecided texts."""

    def rows(kind: str, key: np.ndarray | list, n: np.ndarray | None = None, word: list | None = None, texts: list | None = None) -> pa.RecordBatch:
        size = len(key)
        n = np.zeros((size, 3), dtype=np.int64) if n is None else n
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size, pa.string()), pa.array(key, pa.int64()), pa.array(word or [None] * size, pa.string()), *(pa.array(n[:, j], pa.int64()) for j in range(3)), pa.array(texts or [None] * size, pa.binary())],
            names=["kind", "key", "word", "a", "b", "c", "texts"],
        )

    def of_words(words: Counter) -> pa.RecordBatch:
        n = np.zeros((len(words), 3), dtype=np.int64)
        n[:, 0] = list(words.values())
        return rows("word", [k for k, _ in words], n, [w for _, w in words])

    tokens, marks = Tokens(seed_language()), Marks()
    words: Counter = Counter()
    features = np.zeros((SLOTS + 2, 3), dtype=np.int64)
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 1000):  # very long texts must not add up
            asked, answers, refused = (c.to_pylist() for c in b.slice(at, 1000).columns)
            words.update(sure_words(tokens, tokens.sentences([spoken(q) for q in asked if q])))
            said = [(spoken(a), 0 if r is None else 1 if r else -1) for a, r in zip(answers, refused, strict=True) if a]
            s = tokens.sentences([a for a, _ in said])
            words.update(sure_words(tokens, s))
            more, undecided = declining_counts(s, np.array([r for _, r in said], dtype=np.int8))
            features += more
            if len(undecided.sentences):
                yield rows("undecided", [len(undecided.sentences)], texts=[undecided.pack()])
            k, n = context_keys(answers, marks)
            keys, counts = sums_by(np.append(keys, k), np.concatenate([counts, n]))
            if len(words) > KEEP:
                yield of_words(words)
                words = Counter()
            if len(keys) > KEEP:
                yield rows("context", keys, counts)
                keys, counts = keys[:0], counts[:0]
    slot = np.flatnonzero(features.any(axis=1))
    yield of_words(words)
    yield rows("context", keys, counts)
    yield rows("feature", slot, features[slot])


def summed(df: DataFrame, key: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sums of their columns, at the driver."""
    got = df.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    keys = got[key].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], np.stack([got[c].to_numpy() for c in columns], axis=1).astype(np.int64)[order]


def language_of_all(found: DataFrame) -> Language:
    """The model of languages from the seed and all words of EVIDENCE."""
    spark = found.sparkSession
    seed = [(i, w, SEED_WEIGHT * n) for i, lang in enumerate(LANGUAGES) for w, n in seed_words()[lang].items()]
    words = found.where("kind = 'word'").select("key", "word", "a").unionByName(spark.createDataFrame(seed, "key long, word string, a long")).groupBy("key", "word").agg(F.sum("a").alias("a"))
    names = [f"w{i}" for i in range(len(LANGUAGES))]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                slots, weights, seen = count_grams(zip(*(c.to_pylist() for c in b.slice(at, 2000).columns), strict=True))
                weights = np.concatenate([weights, seen[None]])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), *(pa.array(weights[:, i]) for i in range(len(names)))], names=["slot", *names])

    slots, weights = summed(words.mapInArrow(grams, ", ".join(["slot long", *(f"{x} long" for x in names)])), "slot", names)
    return Language.of_counts(slots[1:], weights[1:], weights[0])  # slot -1 is first


def declining_of_all(found: DataFrame) -> Declining:
    """The model of declining from the seed and all texts of EVIDENCE."""
    slots, n = summed(found.where("kind = 'feature'"), "key", ["a", "b", "c"])
    counts = np.zeros((SLOTS + 2, 3), dtype=np.int64)
    counts[slots] = n
    texts = found.where("kind = 'undecided'").select("texts")

    def total(of: Callable[[Undecided], np.ndarray], size: int) -> np.ndarray:
        """The sums of what is worked out of all undecided texts."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size, dtype=np.int64)
            for b in batches:
                for x in b.column(0):
                    out += of(Undecided.unpack(x.as_py())).ravel()
            slot = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(out[slot])], names=["slot", "n"])

        out = np.zeros(size, dtype=np.int64)
        slot, n = summed(texts.mapInArrow(part, "slot long, n long"), "slot", ["n"])
        out[slot] = n[:, 0]
        return out

    return learn_declining(counts, lambda model: total(lambda x: x.rates(model), 4).reshape(2, 2), lambda model, told: total(lambda x: x.weights(model, told), SLOTS + 1))


def defective_pairs(answers: DataFrame) -> DataFrame:
    """(answer_id, defect): one row of each defective pair. answers: answer_id, question, answer, refused, recorded_at.

    Of several rows of an answer_id the one recorded last counts (of these the larger text). A null, blank or
    placeholder answer is 'empty'; a pair without a question can't be a copy or in another language; null answer_ids are
    left out; an empty table gives no rows; whole texts are read. No other column is read. What refused says is never
    taken for a row's own verdict: over all rows it is where the model of declining begins.
    """
    spark = answers.sparkSession
    rows = answers.where("answer_id IS NOT NULL").select("answer_id", "question", "answer", "recorded_at")
    refused = F.col("refused").cast("boolean") if "refused" in answers.columns else F.lit(None).cast("boolean")
    found = materialise(answers.where("answer_id IS NOT NULL").select("question", "answer", refused.alias("refused")).mapInArrow(evidence, EVIDENCE), "pairs")
    keys, n = summed(found.where("kind = 'context'"), "key", ["a", "b", "c"])
    ending = Ending(seed_counts() + by_slot(keys, n))
    model = spark.sparkContext.broadcast((language_of_all(found), declining_of_all(found), ending, ending.thresholds(keys, n)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = Judge(*model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # very long texts must not add up
                part = b.slice(at, 1000)
                texts = part.column(2).to_pylist()
                said = say(part.column(1).to_pylist(), texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), part.column(3), pa.array([len(a or "") for a in texts], pa.int64())], names=["answer_id", "defect", "recorded_at", "size"])

    when = rows.schema["recorded_at"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"answer_id string, defect string, recorded_at {when}, size long")
    last = judged.groupBy("answer_id").agg(F.max(F.struct("recorded_at", "size", "defect"))["defect"].alias("defect"))
    return last.where("defect IS NOT NULL")
