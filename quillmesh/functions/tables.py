"""Fixed values of the text functions: maps, lists, weights and limits that results depend on."""

from __future__ import annotations

# The letter a digit or sign stands for first.
LEET_FROM, LEET_TO = "0123456789@$!", "oizeasgtbgasi"

# Characters and the Latin letter or digit they look like.
CONFUSABLE_FROM = "аеорсухіјѕһԁԃԍԛԝԟԡԣԧԩԫԭԯґқңғҷүұҳӯӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαντυϲϳϵϱϰϴϹϺϻϽϿⅠАВЕКМНОРСТХЀЅІЈЉЊЌЎЏѓљњќўџ０１２３４５６７８９ａｐｙｌ"
CONFUSABLE_TO = "aeopcyxijshddnqwplhhhhotrqnfjyyhylABEZHIKMNOPTYXavtucjepkOCMmCCIABEKMHOPCTXESIJLNKYDrlnkyd0123456789apyl"

# Blanks beside the usual ones.
EXTRA_BLANKS = "\u0085  ᠎ -​  　"
# Invisible characters and controls of writing direction, as class bodies.
INVISIBLE = "­؀-؅؜۝܏࢐-࢑᠎​-‏ -‮⁠-⁯﻿￹-￻\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f"
BIDI = "؜‎‏‪-‮⁦-⁩"
COMBINING = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
FULL_WIDTH = "！-｠￠-￮"
SELECTORS = "︀-️"
JOINERS = "‌‍"

# Scripts that are told apart by name.
SCRIPTS = ["Arabic", "Armenian", "Bengali", "Cyrillic", "Devanagari", "Georgian", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Katakana", "Latin", "Thai"]

# Weights of the evidence channels, by profile.
CHANNELS = ["semantic", "lexical", "character", "visual", "phonetic", "symbolic", "decoded", "obfuscation"]
PROFILES = {
    "general_similarity": dict(zip(CHANNELS, (0.20, 0.10, 0.10, 0.10, 0.15, 0.10, 0.20, 0.05), strict=True)),
    "duplicate": dict(zip(CHANNELS, (0.10, 0.20, 0.20, 0.20, 0.10, 0.05, 0.10, 0.05), strict=True)),
    "spam": dict(zip(CHANNELS, (0.05, 0.10, 0.10, 0.20, 0.05, 0.05, 0.20, 0.25), strict=True)),
    "obfuscation": dict(zip(CHANNELS, (0.05, 0.05, 0.15, 0.30, 0.05, 0.10, 0.20, 0.10), strict=True)),
    "rebus": dict(zip(CHANNELS, (0.20, 0.20, 0.05, 0.05, 0.20, 0.20, 0.10, 0.0), strict=True)),
}
# Features between the channels of a pair, and the trained pair scorer.
PAIR_FEATURES = [
    "lexicon_validity", "single_word_pair", "swapped_word_similarity", "swapped_phonetic", "confusable_swap", "valid_swap_similarity", "normalized_identity", "substring_containment", "cross_script_pair", "cross_script_agreement",
    "exact_decode", "single_word_exact", "fuzzy_decode_mismatch", "contextual_semantic", "cross_language_semantic", "entity_agreement", "entity_conflict", "semantic_without_lexical_overlap", "transliteration_semantic_agreement", "transliteration_semantic_conflict",
]
PAIR_BIAS, PAIR_TEMPERATURE = -0.279964997572074, 0.9199999999999999
PAIR_WEIGHTS = {
    "semantic": 0.6040772648125725,
    "lexical": 0.3075653087232212,
    "character": 3.474418689182039,
    "visual": -2.9936429909582736,
    "phonetic": -1.5899583775463888,
    "symbolic": -0.08448307960189841,
    "decoded": 7.905670290298654,
    "obfuscation": -2.100754058293024,
    "channel_confidence": -3.3223551766428225,
    "language_agreement": -0.5672166344521737,
    "lexicon_validity": -1.029786370595682,
    "single_word_pair": -1.7909505888499744,
    "swapped_word_similarity": 2.4075141867946384,
    "swapped_phonetic": -1.0167710370267689,
    "confusable_swap": -2.51474158909012,
    "valid_swap_similarity": -9.162923035077327,
    "normalized_identity": 4.646865515038739,
    "substring_containment": 0.1998502702304597,
    "cross_script_pair": 1.4725221921565135,
    "cross_script_agreement": -1.1683243692679683,
    "exact_decode": 4.946474774325327,
    "single_word_exact": -0.7989886654819373,
    "fuzzy_decode_mismatch": -1.4508678473087102,
    "contextual_semantic": 0.0,
    "cross_language_semantic": 1.0764496964859107,
    "entity_agreement": 1.5584748736920526,
    "entity_conflict": -2.8878991309509856,
    "semantic_without_lexical_overlap": 1.910601326739771,
    "transliteration_semantic_agreement": 0.04127767923326416,
    "transliteration_semantic_conflict": 1.6403000814138267,
}
# Weights of the second ranking.
RERANK = {"base": 1.5, "decoded": 1.2, "semantic": 1.0, "lexical": 0.8, "phonetic": 0.6, "visual": 0.4, "symbolic": 0.5, "character": 0.4, "obfuscation": 0.2, "language_agreement": 0.3, "bias": -1.0}

# The trained spam scorer.
SPAM_BIAS, SPAM_THRESHOLD = -10.015323725053156, 0.42842184470594946
SPAM_WEIGHTS = {
    "url_count": 0.0,
    "email_count": 0.23625257885022585,
    "emoji_count": -0.46597531282141874,
    "number_ratio": 5.7422130531508335,
    "emoji_ratio": -0.024150073105916808,
    "uppercase_ratio": 0.7000030103754242,
    "punctuation_ratio": -2.192327770395279,
    "entropy": 3.2004290153056276,
    "repetition_score": -0.5169085294402265,
    "obfuscation_score": 1.6178522955824568,
    "pattern_score": 0.0,
    "decoded_similarity": -5.784507067453083,
    "semantic_pattern_similarity": 0.0,
    "mixed_scripts": 0.0,
    "confusable_count": 0.0,
}

# Weights of the character similarity.
CHARACTER = {"levenshtein": 0.2, "damerau": 0.15, "jaro": 0.15, "jaro_winkler": 0.2, "ngram": 0.15, "lcs": 0.15}

# One-to-one transcription of Cyrillic letters, then those that give several.
CYRILLIC_FROM, CYRILLIC_TO = "абвгдезийклмнопрстуфыэіґў", "abvgdeziyklmnoprstufyeigw"
CYRILLIC_LONG = {"ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "'", "ю": "yu", "я": "ya", "ї": "yi", "є": "ye"}
LATIN_DIGRAPHS = {"shch": "щ", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я", "yo": "ё", "ye": "е", "yi": "и", "ks": "кс"}
LATIN_SINGLE_FROM, LATIN_SINGLE_TO = "abcdefghijklmnopqrstuvwyz'", "абкдефгхижклмнопкрстуввйзь"
ARABIC = dict(zip("اأإآىةبتثجحخدذرزسشصضطظعغفقكلمنهوي", "a a a a a a b t th j h kh d dh r z s sh s d t z ' gh f q k l m n h w y".split(" "), strict=True))

# Sounds of letters; letters before e or i and pairs follow in the rules.
VOWEL_SOUNDS = {"a": "aáàâäãåāăą", "e": "eéèêëēėę", "ɪ": "iyíìîïĩīįýÿ", "o": "oóòôöõøōőœ", "u": "uúùûüũūůűų"}
LETTER_SOUNDS = {"b": "b", "v": "b", "c": "k", "ç": "s", "d": "d", "f": "f", "g": "g", "j": "dʒ", "k": "k", "l": "l", "m": "m", "n": "n", "ñ": "ɲ", "p": "p", "r": "ɾ", "s": "s", "z": "s", "t": "t", "w": "w", "x": "ks"}
PAIR_SOUNDS = {"ch": "tʃ", "rr": "r", "qu": "k"}
IPA_LONG = ["t͡ʃ", "d͡ʒ", "tʃ", "dʒ", "aɪ", "aʊ", "eɪ", "ɔɪ", "ks"]
IPA_SKIPPED = " \t\n.,|/ˈˌ:ːʲʷ"

# Limits.
INPUT_CHARS, SEGMENTS, ENTITIES, ENTITY_CHARS = 8192, 256, 16, 64
PER_LIST, CANDIDATES = 200, 500
