"""Vocabularies and patterns of catalog names.

Patterns are valid in Java, RE2 and Python; ``(?i)`` marks those that ignore case.
"""

from __future__ import annotations

# Regions in order of precedence: code, name, language, pattern of its short tags (or none).
REGIONS: list[tuple[str, str, str, str | None]] = [
    ("ARG", "Argentina", "ES", r"(?i)\(AR\)"),
    ("AUS", "Australia", "EN", r"(?i)\((A|AU)\)"),
    ("BEL", "Belgium", "FR", r"(?i)\(BE\)"),
    ("BRA", "Brazil", "PT", r"(?i)\((B|BR)\)"),
    ("CAN", "Canada", "EN", r"(?i)\((C|CA)\)"),
    ("CHN", "China", "ZH", r"(?i)\((C|CH|CHI|CN)\)"),
    ("DAN", "Denmark", "DA", r"(?i)\(DK\)"),
    ("FRA", "France", "FR", r"(?i)\((F|FR)\)"),
    ("FYN", "Finland", "FI", r"(?i)\((FI|FN)\)"),
    ("GER", "Germany", "DE", r"(?i)\((DE|G|GE)\)"),
    ("GRE", "Greece", "EL", r"(?i)\(GR\)"),
    ("HK", "Hong Kong", "ZH", r"(?i)\(HK\)"),
    ("HOL", "Netherlands", "NL", r"(?i)\((D|H|NL)\)"),
    ("ITA", "Italy", "IT", r"(?i)\((I|IT)\)"),
    ("JPN", "Japan", "JA", r"(?i)\((1|J|JP)\)"),
    ("KOR", "Korea", "KO", r"(?i)\((K|KR)\)"),
    ("MEX", "Mexico", "ES", r"(?i)\(MX\)"),
    ("NOR", "Norway", "NO", r"(?i)\(No\)"),
    ("NZ", "New Zealand", "EN", None),
    ("POR", "Portugal", "PT", r"(?i)\((P|PT)\)"),
    ("RUS", "Russia", "RU", r"(?i)\((R|RU)\)"),
    ("SPA", "Spain", "ES", r"(?i)\((ES|S)\)"),
    ("SWE", "Sweden", "SV", r"(?i)\((SE|SW)\)"),
    ("TAI", "Taiwan", "ZH", r"(?i)\(TW\)"),
    ("UK", "United Kingdom", "EN", r"(?i)\((GB|UK)\)"),
    ("UNK", "Unknown", "EN", r"(?i)\(Unk\)"),
    ("USA", "USA", "EN", r"(?i)\((4|5|U|US)\)"),
    ("ASI", "Asia", "ZH", r"(?i)\(As\)"),
    ("EUR", "Europe", "EN", r"(?i)\((8|E|EU|PAL)\)"),
    ("", "Scandinavia", "", None),
    ("WORLD", "World", "EN", r"(?i)\((F|W|WO)\)"),
]
# Three-letter language codes and the two-letter ones they stand for.
LONG_LANGUAGES = {"DAN": "DA", "GER": "DE", "ENG": "EN", "SPA": "ES", "FRE": "FR", "ITA": "IT", "DUT": "NL", "NOR": "NO", "SWE": "SV", "CHI": "ZH"}

LANGUAGES = sorted({language for _, _, language, _ in REGIONS if language})

# Patterns of the tags in a name.
TAGS: dict[str, str] = {
    "bios": r"(?i)\[BIOS\]",
    "aftermarket": r"(?i)\(Aftermarket[a-z0-9. ]*\)",
    "alpha": r"(?i)\(Alpha[a-z0-9. ]*\)",
    "alternate": r"(?i)\(Alt( [a-z0-9. ]*)?\)|\[a[0-9]*\]",
    "bad": r"\[b[0-9]*\]",
    "beta": r"(?i)\(Beta[a-z0-9. ]*\)",
    "cracked": r"\[cr([0-9]+| [^\]]+)?\]",
    "debug": r"(?i)\(Debug[a-z0-9. ]*\)",
    "demo": r"(?i)\(Demo[a-z0-9. -]*\)|@barai|\(Kiosk[a-z0-9. -]*\)|\(Preview\)|GameCube Preview|Kiosk Demo Disc|PS2 Kiosk|PSP System Kiosk|Taikenban|Trial Edition",
    "enhancement_chip": r"(?i)\(Enhancement Chip\)",
    "fixed": r"\[f[0-9]*\]",
    "homebrew": r"(?i)\(Homebrew[a-z0-9. ]*\)",
    "mia": r"(?i)\[MIA\]",
    "overdump": r"\[o[0-9]*\]",
    "pirated_paren": r"(?i)\(Pirate[a-z0-9. ]*\)",
    "pirated_bracket": r"\[p[0-9]*\]",
    "program": r"(?i)\([a-z0-9. ]*Program\)|(Check|Sample) Program",
    "prototype": r"(?i)\([^)]*Proto[a-z0-9. ]*\)",
    "sample": r"(?i)\([^)]*Sample[a-z0-9. ]*\)",
    "translated": r"\[T[+-][^\]]+\]",
    "unlicensed": r"(?i)\(Unl[a-z0-9. ]*\)",
    "bung_fix": r"(?i)\(Bung\)|\[bf\]",
    "hack_paren": r"(?i)\(Hack\)",
    "hack_bracket": r"\[h[a-zA-Z90-9+]*\]",
    "trainer": r"\[t[0-9]*\]",
}
REVISION_NUMBER = r"(?i)\((Rev|Version)\s*([0-9.]+)\)"
REVISION_LETTER = r"(?i)\(Rev\s*([A-Z])\)"
VERSION = r"(?i)\Wv([0-9]+\.[0-9]+)\W"
RING_CODE = r"(?i)\(RE?-?([0-9]*)\)"
TWO_LETTERS = r"\(([a-zA-Z]{2}([,+-][a-zA-Z]{2})*)\)"
THREE_LETTERS = r"\(([a-zA-Z]{3}(-[a-zA-Z]{3})*)\)"
_NAMES = "|".join(name for _, name, _, _ in REGIONS)
LONG_REGIONS = rf"(?i)\((({_NAMES})(, ({_NAMES}))*)\)"

# Kinds of game in the order in which they are tried, after BIOS and verified.
GAME_TYPES = "Aftermarket Alpha Bad Beta Cracked Debug Demo Device Fixed Hacked Homebrew Overdump Pending_Dump Pirated Program Prototype Sample Trained Translated Unlicensed".split()


def _codes(words: list[str]) -> str:
    return rf"(?i)\((({'|'.join(words)})[,+-]? ?)+\)"


#: What is removed from a name to drop its regions and languages; the first match of each, in order.
REGION_LANGUAGE_TAGS: list[str] = [
    _codes(sorted({code for code, _, _, _ in REGIONS if code})),
    _codes(sorted({name for _, name, _, _ in REGIONS})),
    r"(?i)\(Latin America\)",
    *(p for _, _, _, p in REGIONS if p),
    _codes(LANGUAGES),
]

# What is replaced in a name to drop its variant; the first match of each, in order.
VARIANT_TAGS: list[tuple[str, str]] = [
    (r"(?i)\(Alt( [a-z0-9. ]*)?\)", ""),
    (r"(?i)\([^)]*Collector's Edition\)", ""),
    (r"(?i)\(Digital Release\)", ""),
    (r"(?i)\(Disney Classic Games\)", ""),
    (r"(?i)\(Evercade\)", ""),
    (r"(?i)\(Extra Box\)", ""),
    (r"(?i) - European Version", ""),
    (r"(?i)\(Fukkokuban\)", ""),
    (r"(?i)\([^)]*Genteiban\)", ""),
    (r"(?i)\(Limited[^)]+Edition\)", ""),
    (r"(?i)\(Limited Run Games\)", ""),
    (r"(?i)\(LodgeNet\)", ""),
    (r"(?i)\(Made in [^)]+\)", ""),
    (r"(?i)\(Major Wave\)", ""),
    (r"(?i)\((Midway Classics)\)", ""),
    (r"(?i)\([^)]*Premium [^)]+\)", ""),
    (r"(?i)\([^)]*Preview Disc\)", ""),
    (r"(?i)\(QUByte Classics\)", ""),
    (r"(?i)\(Recalled\)", ""),
    (r"(?i)\(Renkaban\)", ""),
    (r"(?i)\(Reprint\)", ""),
    (r"(?i)\(Rerelease\)", ""),
    (r"(?i)\(Retro-Bit\)", ""),
    (r"(?i)\((Rev|Version)\s*[a-z0-9.-]*\)", ""),
    (r"(?i)\([^)]*Seisanban\)", ""),
    (r"(?i)\(Shotenban\)", ""),
    (r"(?i)\(Special Pack\)", ""),
    (r"(?i)\(Steam\)", ""),
    (r"(?i)\(Switch Online\)", ""),
    (r"(?i)\([^)]+ the Best\)", ""),
    (r"(?i)\([^)]*Taiouban[^)]*\)", ""),
    (r"(?i)\([^)]*Tokubetsu-?ban[^)]*\)", ""),
    (r"(?i)\([^)]*Virtual Console\)", ""),
    (r"\([0-9]{4}-[0-9]{2}-[0-9]{2}\)", ""),
    (TAGS["aftermarket"], ""),
    (TAGS["alpha"], ""),
    (TAGS["beta"], ""),
    (r"(?i)\(Build [a-z0-9. ]+\)", ""),
    (r"(?i)\(Bung\)", ""),
    (TAGS["debug"], ""),
    (TAGS["demo"], ""),
    (TAGS["hack_paren"], ""),
    (TAGS["homebrew"], ""),
    (r"(?i)\(Kiosk[^)]*\)", ""),
    (r"(?i)\(Not for Resale\)", ""),
    (r"(?i)\(PD\)", ""),
    (TAGS["pirated_paren"], ""),
    (TAGS["program"], ""),
    (TAGS["prototype"], ""),
    (TAGS["sample"], ""),
    (r"(?i)\(Spaceworld[a-z0-9. ]*\)", ""),
    (TAGS["unlicensed"], ""),
    (r"(?i)\(v[0-9.-]+[a-z]*\)", ""),
    (r"(?i)\(Version [0-9.]+[a-z]*\)", ""),
    (r"\[!\]", ""),
    (r"\[a[0-9]*\]", ""),
    (TAGS["bad"], ""),
    (r"\[bf\]", ""),
    (r"\[c\]", ""),
    (TAGS["fixed"], ""),
    (TAGS["hack_bracket"], ""),
    (r"\[MIA\]", ""),
    (TAGS["overdump"], ""),
    (r"\[!p\]", ""),
    (TAGS["pirated_bracket"], ""),
    (TAGS["trainer"], ""),
    (TAGS["translated"], ""),
    (r"\[x\]", ""),
    (r"(?i)\(Wxn\)", ""),
    (r"\((SC-3000|SG-1000|SF-7000|GG2SMS|MSX2SMS|SG2GG)\)", ""),
    (r"\[(v|eb|eba|ebb|f125|f126)\]", ""),
    (r"\((IQue|MB|MB2GBA)\)", ""),
    (r"\[(C|S|BF)\]", ""),
    (r"\((1|4|5|8|F|B|J-Cart|SN|REVXB|REVSC02|MP|MD Bundle|Alt Music)\)", ""),
    (r"\[(c|x)\]", ""),
    (r"\((RU|PC10|VS|Aladdin|Sachen|KC|FamiStudio|PRG0|PRG1|FDS Hack|GBA E-reader|E-GC|J-GC)\)", ""),
    (r"\[(FDS|FCN|U)\]", ""),
    (r"\((BS|ST|NP|NSS)\)", ""),
    (r"\((Beta-WIP|Debug Version|GC|Save|Save-PAL|Z64-Save)\)", ""),
    (r"\((AE|AL|AS|AT|AU|BA|BE|BG|BR|CA|CH|CL|CN|CS|CY|CZ|DE|DK|EE|EG|ES|EU|FI|FR|GB|GR|HK|HR|HU|ID|IE|IL|IN|IR|IS|IT|JO|JP|KR|LT|LU|LV|MN|MX|MY|NL|NO|NP|NZ|OM|PE|PH|PL|PT|QA|RO|RU|SE|SG|SI|SK|TH|TR|TW|US|VN|YU|ZA)\)", ""),
    (r"\((ar|bg|bs|cs|cy|da|de|el|en|eo|es|et|fa|fi|fr|ga|gu|he|hi|hr|hu|is|it|ja|ko|lt|lv|ms|nl|no|pl|pt|ro|ru|sk|sl|sq|sr|sv|th|tr|ur|vi|yi|zh)\)", ""),
    (r"\((demo|demo-kiosk|demo-playable|demo-rolling|demo-slideshow)\)", ""),
    (r"\([0-9x]{4}(-[0-9x]{2}(-[0-9x]{2})?)?\)", ""),
    (r"(?i)\((CGA|EGA|HGC|MCGA|MDA|NTSC|NTSC-PAL|PAL|PAL-60|PAL-NTSC|SVGA|VGA|XGA)\)", ""),
    (r"\(M[0-9]+\)", ""),
    (r"(?i)\((CW|CW-R|FW|GW|GW-R|LW|PD|SW|SW-R)\)", ""),
    (r"(?i)\((alpha|beta|preview|pre-release|proto)\)", ""),
    (r"(?i)(\[(cr|f|h|m|p|t|tr|o|u|v|b|a|!)([0-9]+| [^\]]+)?\])+", ""),
    (r"(?i)(\W)v[0-9]+\.[0-9]+(\W)", "{1} {2}"),
    (r"'([0-9][0-9])", "{1}"),
    (r"(?i)\(SGB Enhanced\)", ""),
    (r"(?i)\(GB Compatible\)", ""),
    (r"(?i)\(GameCube\)", ""),
    (r"(?i)\(NP\)", ""),
    (r"\[([0-9A-Z ]+(, )?)+\]$", ""),
    (r"\[[0-9]+S\]", ""),
    (r"(?i)\[(compilation|data identical to retail|fixed version|keyboard|limited edition|req\. microphone|scrambled|unscrambled|white label)\]", ""),
    (r"(?i)for Dreamcast", ""),
    (r"(?i)\(MP\)", ""),
    (r"\(RE?-?[0-9]*\)", ""),
    (r"(?i)\(EDC\)", ""),
    (r"(?i)\(PSone Books\)", ""),
    (r"(?i)[(\]](SCES|SCUS|SLES|SLUS)-[0-9]+[(\]]", ""),
    (r"\((Arcade|AVTool|Debug|Disc|Patch|Shop|Tool)\)", ""),
    (r"(?i)[(\]][UN][CLP][AEJKU][BFGHJMSXZ]-[0-9]+[(\]]", ""),
]
#: The one of VARIANT_TAGS of which every match goes.
ALL_MATCHES = {VARIANT_TAGS[-9][0]}

# Tags of tracks and discs; the first match of each goes.
TRACK_TAGS = [r"(?i) ?\(Track [0-9]+\)", r"(?i) ?\(Track [0-9]+ of [0-9]+\)"]
DISC_TAGS = [*TRACK_TAGS, r"(?i) ?\(Dis[ck] [0-9]+\)", r"(?i) ?\(Dis[ck] [0-9]+ of [0-9]+\)"]

# The order in which kinds of container are preferred, from 0.
CONTAINERS = ["file", "zip", "tar", "rar", "7z", "cso", "dolphin", "chd"]
