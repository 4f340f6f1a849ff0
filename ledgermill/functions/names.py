"""Names, categories, questions and messages as Column expressions over rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermill.functions.numbers import plain

OTHER = "Прочее"
# Categories of operations with the stems that name them, in the order of their precedence.
CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Продукты", ("продукт", "супермаркет", "пятёроч", "пятероч", "магнит", "лента", "ашан", "перекрёст", "перекрест", "овощ", "хлеб")),
    ("Кафе и рестораны", ("кафе", "кофе", "ресторан", "столов", "фастфуд", "шаурм", "пицц", "доставка ед", "обед", "ужин", "завтрак", "ланч", "бар")),
    ("Автомобиль", ("машин", "автомоб", "автосервис", "шиномонтаж", "то авто", "страховка авто", "осаго", "каско", "мойк")),
    ("Транспорт", ("такси", "метро", "автобус", "троллейбус", "трамвай", "электричк", "бензин", "топлив", "заправк", "каршеринг", "проезд", "парковк")),
    ("Путешествия", ("отпуск", "отель", "гостиниц", "авиа", "перелёт", "перелет", "путёвк", "путевк", "тур ", "поездк")),
    ("Техника", ("ноутбук", "телефон", "смартфон", "компьютер", "монитор", "наушник", "планшет", "техник")),
    ("Связь и интернет", ("связь", "интернет", "мобильн", "мтс", "билайн", "мегафон", "теле2", "ростелеком")),
    ("Здоровье", ("аптек", "лекарств", "врач", "клиник", "стоматолог", "анализ", "массаж")),
    ("Подписки", ("подписк", "нетфликс", "спотифай", "youtube", "ямусик", "плюс", "icloud")),
    ("Одежда и вещи", ("одежд", "обув", "сумк", "парфюм")),
    ("Развлечения", ("кино", "театр", "концерт", "билет", "настольн", "квест")),
    ("Дом и ремонт", ("стройматериал", "мебель", "бытова", "хозяйств", "канцеляр")),
    ("Подарки", ("подарок", "подарк", "цвет")),
    ("Налоги и взносы", ("налог", "фнс", "пенсионн", "взнос", "таможен")),
    ("Зарплата", ("зарплат", "заработн", "ведомост", "фот", "оплата труда", "аванс")),
    ("Аренда", ("аренд", "лизинг")),
    ("Банк", ("комисси", "банковск", "обслуживание сч", "смс-информ")),
    ("Кредиты и проценты", ("кредит", "займ", "процент по")),
    ("Переводы", ("перевод", "перечисл", "транзит")),
    ("Касса", ("касс", "инкассац", "выручка налич")),
    ("Поставщики и подрядчики", ("поставщик", "подрядчик", "за товар", "за услуги", "счёт №", "счет №", "оплата по счёт")),
)
# Kinds of metrics with their stems, in the order of their precedence.
KINDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("asset", ("актив", "денежн", "дебитор", "запас", "основные средств", "имущество", "вложени")),
    ("liability", ("кредиторск", "обязательств", "пассив", "займ", "заемн", "долг", "кредит")),
    ("expense", ("расход", "затрат", "себестоим", "аренда", "зарплат", "оплат", "налог", "амортиз", "закуп", "коммунал", "процент уплач", "логистик", "платеж")),
    ("revenue", ("выручк", "доход", "продаж", "поступлен", "оборот")),
    ("identifier", ("инн", "кпп", "бик", "огрн", "окпо", "р/с", "расчётн", "расчетн", "счёт №", "счет №", "номер счёт", "лицев счёт", "договор №", "номер договор")),
)
# Words in a column header that name a variant.
VARIANTS = (("план", "plan"), ("бюджет", "budget"), ("прогноз", "forecast"), ("оценк", "estimate"), ("факт", "fact"))
# Latin letters of Cyrillic ones.
LETTERS = {"ж": "zh", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
ONE_TO_ONE = ("абвгдеёзийклмнопрстуфыэ", "abvgdeeziyklmnoprstufye")
# Abbreviations and groups of words that mean the same in reports.
ABBREVIATIONS = (
    ("ндс", "налог на добавленную стоимость"), ("нма", "нематериальные активы"), ("ос", "основные средства"), ("дз", "дебиторская задолженность"), ("кз", "кредиторская задолженность"),
    ("она", "отложенные налоговые активы"), ("оно", "отложенные налоговые обязательства"), ("тмц", "товарно-материальные ценности"), ("фот", "фонд оплаты труда зарплата"),
    ("бфо", "бухгалтерская финансовая отчетность"), ("р-с", "расчётный счёт"), ("финрезультат", "финансовый результат прибыль"),
)
SYNONYMS = (
    ("выручка", "продажи", "доходы от реализации"), ("расходы", "затраты", "издержки"), ("прибыль", "финрезультат", "доходы минус расходы"), ("дебиторка", "дебиторская задолженность"), ("кредиторка", "кредиторская задолженность"),
    ("запасы", "товарно-материальные ценности", "склад"), ("зарплата", "оплата труда", "фонд оплаты труда"), ("аренда", "арендные платежи", "лизинг"), ("налоги", "налоговые платежи", "налоговые обязательства"),
    ("деньги", "денежные средства", "касса"), ("долги", "задолженность", "дебиторская задолженность", "кредиторская задолженность"), ("баланс", "актив", "пассив"), ("автор", "руководитель", "подписавший", "фио", "представитель"),
    ("подписал", "руководитель", "подписавшего", "фио"), ("организация", "наименование", "юридическое лицо", "компания"), ("адрес", "местонахождение", "находится"), ("находится", "местонахождение", "адрес"),
    ("называется", "наименование", "название"), ("аудит", "аудитор", "аудиторская организация"), ("сотрудники", "численность", "персонал", "работники"),
)
# What questions of each intent say, in the order in which they are tried.
INTENTS = (
    ("forecast", r"прогноз|предскаж|ожидат|перспектив|что будет|сколько будет", None),
    ("explain", r"почему|из-за чего|что говорит|объясни|расскажи|риск|упомина|в чем причина|\bкто\b|\bгде\b|\bкогда\b|как называ|автор|подписа|руководител|директор|аудит|\bинн\b|\bкпп\b|\bогрн\b|\bокпо\b|\bбик\b|адрес|местонахожд|наименован|единиц\w* измерен|дата|номер|о чём|о чем|про что|содерж", None),
    ("breakdown", r"из чего состо|структур|разбив|детализ|расшифров|состав показателя", None),
    ("rank", r"каки\w+\s+позици|сильнее всего|больше всего|меньше всего|ранжир|топ[ -]?\d|сам\w+\s+(слаб|сильн|крупн|больш|мал|лучш|худш)|лидер|аутсайдер|худш|лучш|кто упал|что упало|какие .+ (растут|падают)", r"\bили\b|\bvs\b"),
    ("compare", r"по сравнению|сравни|изменил|во сколько|на ?сколько|отлич\w*|рост|снижени|дол[яи] .+ (в|от) |что лучше|лучше .+ или|упал|вырос|растёт|растет|падает|снизил|динамик|тренд|как измен", None),
    ("factual", r"\d|сколько|какая|какой|каков|покажи", None),
)
# Words of a question that say what is asked and not of which metric.
NOT_THE_METRIC = (
    r"прогноз\w*", r"предскаж\w*", r"ожидает\w*", r"перспектив\w*", r"почему", r"из-за чего", r"сравни", r"по сравнению", r"каки\w+\s+позици\w+", r"сколько", r"какая", r"какой", r"какие", r"каков", r"во сколько",
    r"\bбыл\w?\b", r"\bбыли\b", r"\bесть\b", r"\bу\b", r"компани\w*", r"организаци\w*", r"на сколько", r"покажи", r"что\s+говор\w+", r"объясни", r"расскажи", r"год\w*", r"факт\w*", r"план\w*", r"отлич\w*",
    r"структур\w*", r"состав\w*", r"разбивк\w*", r"детализ\w*", r"динамик\w*", r"топ", r"источник\w*", r"канал\w*", r"лучш\w*", r"худш\w*", r"всего", r"итого", r"что будет", r"ожидат\w*", r"сильнее", r"слабее",
    r"\bпо\b", r"\bна\b", r"\bза\b", r"\bесли\b", r"\bтемп\w*", r"\bупад\w*", r"\bвдвое\b", r"\bв\b", r"\bраз\b",
)
# Words and numbers that a scenario is told by.
FALL, RISE = "упад|сниз|замедл|сократ|меньше", "вырас|выраст|ускор|увелич|больше"
TIMES, PERCENT = r"в\s+(\d+(?:[.,]\d+)?)\s*раз", r"на\s+(\d+(?:[.,]\d+)?)\s*%"
FACTORS = (("вдвое", 2.0), ("в два раза", 2.0), ("втрое", 3.0), ("в три раза", 3.0), ("вчетверо", 4.0))

# Patterns of identifiers and their masks, and of units that end a name.
MASKS = (
    (r"(?<!\d)\d{4}\s\d{6}(?!\d)", "[ПАСПОРТ]"),
    (r"(?<![\d.])\d{20}(?!\d)(?![.,]\d)", "[СЧЁТ]"),
    (r"(?<![\d.])(?:\d{10}|\d{12})(?!\d)(?![.,]\d)", "[ИНН]"),
    (r"\+7[\d\s()\-]{10,16}", "[ТЕЛЕФОН]"),
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", "[EMAIL]"),
)
UNIT_TAIL = r"(?iu)[\s,;]*\(?\s*(?:в\s+)?(?:тыс|млн|млрд)\.?\s*(?:руб|₽|долл|usd|eur|евро|шт)?\.?\s*\)?\s*$|[\s,;]*\(?\s*(?:руб|₽|usd|eur|евро|шт|%)\.?\s*\)?\s*$"


def words(pattern: str) -> str:
    r"""``\b`` and ``\w`` of a pattern for text that is not ASCII."""
    out = pattern.replace(r"\w", r"[\p{L}\p{N}_]")
    return "(?iu)" + out.replace(r"\b", r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))")


def first_rule(text: Column, rules, otherwise: str | None) -> Column:
    """Name of the first rule one of whose stems the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(otherwise)
    for name, stems in reversed(tuple(rules)):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in stems)), name).otherwise(out)
    return out


def category_rules():
    """The categories, each also known by the first six letters of its own longer words."""
    return [(name, (*stems, *(w[:6] for w in name.lower().split() if len(w) >= 4))) for name, stems in CATEGORIES]


def categorize(text: Column) -> Column:
    return first_rule(text, category_rules(), OTHER)


def kind_of(name: Column) -> Column:
    return first_rule(name, KINDS, "other")


def detect_variant(text: Column) -> Column:
    return first_rule(text, ((v, (s,)) for s, v in VARIANTS), None)


def clean_name(raw: Column) -> Column:
    """One blank between words, hyphens for dashes, no closing colon, no footnote digits after a letter."""
    s = F.regexp_replace(F.coalesce(plain(raw), F.lit("")), r"\s*[–—]\s*", " - ")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ :;]+|[ :;]+$", "")
    return F.regexp_replace(s, r"(?<=[а-яёa-z)])\d{1,2}$", "")


def strip_unit(name: Column) -> Column:
    """The name without the unit it ends with; a name that is all unit stays."""
    bare = F.regexp_replace(F.regexp_replace(name, UNIT_TAIL, ""), r"^[ ,;:]+|[ ,;:]+$", "")
    return F.when(bare == "", name).otherwise(bare)


def slug(name: Column) -> Column:
    """Latin code of a name, at most 60 characters."""
    s = F.translate(F.lower(name), *ONE_TO_ONE)
    for letter, latin in LETTERS.items():
        s = F.replace(s, F.lit(letter), F.lit(latin))
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    s = F.left(s, F.lit(60))
    return F.when(s == "", F.concat(F.lit("m_"), F.pmod(F.xxhash64(name), F.lit(100_000)).cast("string"))).otherwise(s)


def expand_query(text: Column) -> Column:
    """The question, and the question with what its abbreviations and words also mean, if there is anything to add."""
    base = F.trim(F.coalesce(text, F.lit("")))
    has = lambda w: base.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])")
    parts = [F.when(has(short), F.lit(f" {long}")).otherwise("") for short, long in ABBREVIATIONS]
    for group in SYNONYMS:
        add = F.lit("")
        for word in reversed(group):
            add = F.when(has(word.split()[0]), F.lit(" " + " ".join(g for g in group if g != word))).otherwise(add)
        parts.append(add)
    rich = F.concat(base, *parts)
    return F.when(rich == base, F.array(base)).otherwise(F.array(base, rich))


def anonymize(text: Column, organisations: tuple[str, ...] = ()) -> Column:
    """Passports, accounts, tax numbers, phones, e-mails and the organisations' names (longest first) masked."""
    out = text
    rules = list(MASKS)
    rules += [(rf"(?iu)\Q{name}\E", f"[ORG{i}]") for i, name in enumerate(sorted(filter(None, organisations), key=len, reverse=True))]
    for pattern, mask in rules:
        out = F.regexp_replace(out, pattern, mask)
    return out


def intent(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit("smalltalk")
    for name, yes, no in reversed(INTENTS):
        test = q.rlike(words(yes))
        out = F.when(test & ~q.rlike(words(no)) if no else test, name).otherwise(out)
    return out


def metric_query(question: Column) -> Column:
    """What is left of a question without years, question words and punctuation; all of it, if nothing is."""
    bare = F.regexp_replace(question, words(r"\b20\d\d\b"), "")
    bare = F.regexp_replace(bare, words("|".join(NOT_THE_METRIC)), " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[?.!,;:]+", " "), r"\s+", " "))
    return F.when(bare == "", question).otherwise(bare)


def classify(question: Column) -> Column:
    """struct(intent, metric_query, years, months, target_year, scenario) of a question, by rules alone."""
    from ledgermill.functions.periods import months_in, years_in

    asked, years = intent(question), years_in(question)
    return F.struct(
        asked.alias("intent"), metric_query(question).alias("metric_query"), years.alias("years"), months_in(question).alias("months"),
        F.when((asked == "forecast") & (F.size(years) > 0), F.array_max(years)).alias("target_year"), scenario(question).alias("scenario"),
    )


def scenario(question: Column) -> Column:
    """Growth multiplier that a question supposes: 0.5 for a fall and 1.5 for a rise, unless it names a factor or percent."""
    q = F.lower(F.coalesce(question, F.lit("")))
    down, up = q.rlike(FALL), q.rlike(RISE)
    number = lambda p: F.replace(F.regexp_extract(q, p, 1), F.lit(","), F.lit(".")).try_cast("double")
    factor = number(TIMES)
    for phrase, f in reversed(FACTORS):
        factor = F.when(F.contains(q, F.lit(phrase)), f).otherwise(factor)
    pct = number(PERCENT) / 100
    value = F.when(factor.isNotNull(), F.when(down, 1 / F.nullif(factor, F.lit(0.0))).otherwise(factor)).when(pct.isNotNull(), F.when(down, 1 - pct).otherwise(1 + pct)).otherwise(F.when(down, 0.5).otherwise(1.5))
    return F.when(down | up, value)


def split_chunks(text: Column, most: int = 300, overlap: int | None = None) -> Column:
    """Paragraphs packed into pieces of about ``most`` words; each starts with the last words of the one before.

    A paragraph is never split.
    """
    overlap = most // 6 if overlap is None else max(0, overlap)
    paragraphs = F.filter(F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(p)), lambda p: p != "")
    count = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))

    def pack(state: Column, p: Column) -> Column:
        n = count(p)
        full = (state["n"] + n > most) & (state["n"] > 0)
        own = F.filter(F.split(state["now"], r"\s+"), lambda w: w != "")
        tail = F.array_join(F.slice(own, F.greatest(F.size(own) - overlap + 1, F.lit(1)), overlap), " ") if overlap else F.lit("")
        head = F.when(full, tail).otherwise(state["now"])
        return F.struct(
            F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"]).alias("done"),
            F.when(head == "", p).otherwise(F.concat_ws("\n\n", head, p)).alias("now"),
            (F.when(full, count(head)).otherwise(state["n"]) + n).cast("int").alias("n"),
        )

    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    return F.aggregate(paragraphs, start, pack, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def json_block(text: Column) -> Column:
    """The JSON object in a model's answer: fenced, or from the first brace to the last; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def token_usage(body: Column) -> Column:
    """struct of four counters from a provider's usage object; cached tokens stand in one of two places."""
    at = lambda path: F.get_json_object(body, path).try_cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(
        F.coalesce(at("$.prompt_tokens"), zero).alias("prompt_tokens"), F.coalesce(at("$.completion_tokens"), zero).alias("completion_tokens"),
        F.coalesce(at("$.prompt_tokens_details.cached_tokens"), at("$.prompt_cache_hit_tokens"), zero).alias("cached_tokens"), F.coalesce(at("$.completion_tokens_details.reasoning_tokens"), zero).alias("reasoning_tokens"),
    )
