"""Everything that belongs to one site or one deployment."""

from __future__ import annotations

from dataclasses import dataclass

# Words, names and phrases that have to be these for equal results, as texts.
HEADING_WORDS = ("الفصل", "الباب", "المبحث", "المطلب", "المسألة", "تمهيد", "مقدمة", "خاتمة", "الفرع", "الجزء")
ORDINALS = ("أولاً", "ثانياً", "ثالثاً", "رابعاً", "خامساً", "سادساً", "سابعاً", "ثامناً", "تاسعاً", "عاشراً")
NOISE_ELEMENTS = ("script", "style", "noscript", "svg", "iframe", "header", "footer", "nav")
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
REFUSAL = "المعلومات المتوفرة لا تجيب عن السؤال مباشرة."
NO_RESULTS = "لا تتوفر معلومات كافية للإجابة."
ABSTENTIONS = ("المعلومات المتوفرة لا تجيب عن السؤال مباشرة", "لا تتوفر معلومات كافية للإجابة")
SOURCES_HEADER = "### 📚 المصادر المستخدمة:"
VERDICT_PARTS = ("faithfulness", "relevance", "correctness", "fluency")
# End of the fixed values.


@dataclass(frozen=True)
class Site:
    """Which pages of a site belong to the collection, and where their main text stands."""

    domain: str = "example.com"
    section: str = "/"
    language_prefixes: tuple[str, ...] = ("/en/",)
    excluded_prefixes: tuple[str, ...] = ("/_layouts/", "/images/", "/siteassets/")
    #: (tag, attribute, value) of the nodes that may hold the main text, in order of trust.
    selectors: tuple[tuple[str, str, str], ...] = (("", "id", "PageContent"), ("", "class", "main-text"), ("article", "", ""), ("main", "", ""))
    #: Path prefixes whose quoted .aspx links count, in any case.
    script_paths: tuple[str, ...] = ()
    content_types: tuple[str, ...] = CONTENT_TYPES


@dataclass(frozen=True)
class Phrases:
    """Fixed texts of the answering plan."""

    refusal: str = REFUSAL
    no_results: str = NO_RESULTS
    sources_header: str = SOURCES_HEADER
    abstain: tuple[str, ...] = ABSTENTIONS
    greeting: str = "مرحبا، اكتب سؤالك."
    apology: str = "تعذر إكمال الطلب."
    instructions: str = (
        "أنت مساعد يجيب عن الأسئلة بالاعتماد على المقاطع المعطاة وحدها. التزم بما يلي: "
        "خذ كل معلومة من المقاطع، ولا تزد عليها شيئا من عندك ولا من خارج سياقها. "
        "اجمع بين المقاطع إذا تكاملت. "
        "اذكر بعد كل معلومة رقم مقطعها بين قوسين مربعين مثل [1]، ولا تذكر مصدرا غير ما في المقاطع ولا رقما لم تأخذ منه. "
        "خذ من المقاطع ذات النص العربي دون غيرها. "
        f"إذا لم تجب المقاطع عن السؤال فقل: {REFUSAL} وإذا لم تجد فيها جوابا فقل إنه لا تتوفر لديك معلومات."
    )


SITE, PHRASES = Site(), Phrases()
