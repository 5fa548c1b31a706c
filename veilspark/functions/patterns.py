"""What is looked for: a registry of recognizers, each with patterns, a validator and context words."""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import checks


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str  # Java dialect; (?U) gives \d, \s, \w and \b their Unicode meaning
    score: float


@dataclass(frozen=True)
class Recognizer:
    """validator: a match that passes scores 1.0, one that fails is dropped.  keeps_score: a match that passes keeps the
    pattern's score.  needs: a cheap test, as a regular expression, without which no pattern can match."""

    entity: str
    patterns: tuple[Pattern, ...]
    validator: checks.Validator | None = None
    keeps_score: bool = False
    context: tuple[str, ...] = ()
    needs: str = ""


# The patterns, scores and context words that results depend on.
_STREET = r"(?:ул\.?|улица|пр-т|проспект|пер\.?|переулок|б-р|бульвар|шоссе|ш\.?)\s*[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,50}?[,\.]?\s*(?:д\.|дом)?\s*\d+[а-яё]?"
PHONE = Recognizer(
    "PHONE_NUMBER",
    (
        Pattern("country_code", r"(?U)(?:\+?7|8)[\s\-\.]?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{2}[\s\-\.]?\d{2}", 0.85),
        Pattern("mobile", r"(?U)(?<!\d)9\d{9}(?!\d)", 0.5),
    ),
    checks.phone,
    context=("телефон", "тел", "тел.", "мобильный", "сотовый", "звонить", "позвонить", "набрать", "номер", "phone", "tel", "mobile", "call", "контактный", "т.", "mob."),
    needs=r"\p{Nd}{2}",
)
EMAIL = Recognizer(
    "EMAIL_ADDRESS",
    (Pattern("address", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.85),),
    context=("email", "почта", "е-мейл", "электронная почта", "e-mail", "почтовый адрес", "ящик", "написать", "отправить", "связаться"),
    needs="@",
)
INN = Recognizer(
    "RU_INN",
    (Pattern("individual", r"(?U)(?<!\d)\d{12}(?!\d)", 0.4), Pattern("company", r"(?U)(?<!\d)\d{10}(?!\d)", 0.4)),
    checks.inn,
    keeps_score=True,
    context=("инн", "индивидуальный номер налогоплательщика", "налог", "налоговый", "налоговая", "inn", " taxpayer", "огрн", "огрнип", "кпп"),
    needs=r"\p{Nd}{10}",
)
INN_STRICT = replace(INN, patterns=(replace(INN.patterns[0], score=0.3), replace(INN.patterns[1], score=0.2)))
SNILS = Recognizer(
    "RU_SNILS",
    (Pattern("formatted", r"(?U)\b\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}\b", 0.4), Pattern("plain", r"(?U)(?<!\d)\d{11}(?!\d)", 0.2)),
    checks.snils,
    context=("снилс", "страховой номер", "пенсионный", "пенсия", "страховое свидетельство", "сзо", "адвр"),
    needs=r"\p{Nd}{3}",
)
PASSPORT = Recognizer(
    "RU_PASSPORT",
    (Pattern("spaced", r"(?U)\b\d{2}\s\d{2}\s\d{6}\b", 0.5), Pattern("compact", r"(?U)\b\d{4}\s\d{6}\b", 0.4)),
    checks.passport,
    context=("паспорт", "паспортные данные", "серия", "номер паспорта", "удостоверение личности", "документ", "passport", "удл"),
    needs=r"\p{Nd}{6}",
)
CARD = Recognizer(
    "CREDIT_CARD",
    (
        Pattern("sixteen", r"(?U)\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0.6),
        Pattern("eighteen", r"(?U)\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{2}\b", 0.4),
    ),
    checks.card,
    context=("карта", "банковская карта", "номер карты", "карточка", "кредитная", "дебетовая", "visa", "mastercard", "мир", "счёт", "оплата", "платёж", "cvv", "cvc"),
    needs=r"\p{Nd}{4}",
)
ADDRESS = Recognizer(
    "RU_ADDRESS",
    (
        Pattern("full", r"(?U)" + _STREET + r"\s*(?:[,/]\s*(?:корп\.|корпус|стр\.)\s*\d+[а-яё]?)?(?:\s*[,\.]?\s*(?:кв\.|квартира|оф\.|офис)\s*\d+)?", 0.7),
        Pattern("street_house", r"(?U)" + _STREET, 0.6),
        Pattern("name_type_house", r"(?U)[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,50}?\s+(?:ул\.?|улица|проспект|пер\.?|переулок|бульвар|шоссе)[,\.]?\s*(?:д\.|дом)?\s*\d+[а-яё]?", 0.6),
        Pattern("city_street", r"(?U)(?:г\.|гор\.|пос\.|с\.|дер\.)\s*[А-ЯЁ][а-яёА-ЯЁ\-]{1,30}[\s,]+(?:ул\.?|улица|пр-т|проспект)\s*[А-ЯЁ][а-яёА-ЯЁ\s\-]{1,40}", 0.6),
    ),
    context=("адрес", "проживает", "зарегистрирован", "место жительства", "дом", "квартира", "улица", "район", "прописка", "регистрация", "фактический адрес"),
    needs="[А-ЯЁ]",
)

#: In this order; it settles what scores and places leave open.
RECOGNIZERS: tuple[Recognizer, ...] = (PHONE, EMAIL, INN, SNILS, PASSPORT, CARD, ADDRESS)


def recognizers(entities: list[str] | None = None, *, detect_bare_inn: bool = True, extra: tuple[Recognizer, ...] = ()) -> list[Recognizer]:
    """The registry, cut to the entities asked for; `extra` recognizers follow the built-in ones."""
    own = [INN_STRICT if r is INN and not detect_bare_inn else r for r in RECOGNIZERS] + list(extra)
    wanted = None if entities is None else {e.upper() for e in entities}
    return [r for r in own if wanted is None or r.entity.upper() in wanted]
