"""Word lists and letter tables whose content decides results."""

# What a unit becomes after an integer token.
UNITS_AFTER_NUMBER = {
    "г": "грамм", "грам": "грамм", "гр": "грамм", "gr": "грамм", "g": "грамм",
    "ml": "мл", "милл": "мл", "млитр": "мл", "млтр": "мл",
    "ш": "шт",
    "тон": "тонна", "тн": "тонна", "тонн": "тонна", "т": "тонна",
    "л": "литр", "лит": "литр",
    "kg": "кг",
    "mm": "мм", "cm": "см", "м": "метр", "m": "метр",
    "gb": "гб", "mb": "мб",
    "№": "номер",
    "ват": "ватт", "вт": "ватт", "w": "ватт", "в": "вольт", "v": "вольт",
    "а": "ампер", "a": "ампер", "hz": "герц", "гц": "герц",
}

# What a unit becomes in normalised text.
UNITS_NORMAL = {
    "г": "грамм", "грам": "грамм", "гр": "грамм", "грамм": "грамм", "gr": "грамм",
    "ml": "мл", "милл": "мл", "млитр": "мл", "млтр": "мл", "мл": "мл",
    "ш": "шт", "шт": "шт",
    "тон": "тонна", "тн": "тонна", "тонна": "тонна", "тонн": "тонна",
    "л": "литр", "литр": "литр", "лит": "литр",
    "kg": "кг", "кг": "кг",
    "mm": "мм", "cm": "см", "мм": "мм", "см": "см", "дм": "дм",
    "№": "номер", "номер": "номер",
    "ват": "ватт", "вт": "ватт", "ватт": "ватт",
}

# Symbols that count as white space, and those that normalisation drops.
SPACE_SYMBOLS = "ъ*!\"#$&'()+-/:;<=>?@[\\]^_`{|}~"
BRACKET_SYMBOLS = "~/-\\[]()|{}:^+"

# Latin letters in Cyrillic; x becomes two letters.
LATIN = "abcdefghijklmnopqrstuvwyz"
CYRILLIC = "абцдефгхийклмнопкрстуввыз"
LATIN_X = "кс"

# Catalogue words that say nothing, besides the usual Russian stop words.
CATALOGUE_STOP_WORDS = (
    "принадлежность вид товар продукт изделие прочий продукция карточка отдел исключать прочее штучный "
    "заблокировать сопутствовать зона группа отечественный обычный эконом импорт свыше категории категория "
    "категорияноменклатуры товары прочие используются производители основная основной каталог номенклатурная "
    "арт материалы оборудование россия"
).split()
