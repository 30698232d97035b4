"""The vocabularies of the citation systems, in the order of their priority.

A vocabulary is a table (system, priority, ordinal, siglum, spoken, shape); `vocabulary` gives the fixed one, and a caller may
pass another or overlay tiers of own sigla (`operators.relations.overlaid`)."""

from __future__ import annotations

# siglum = spoken form, by system; the shape of the locators that follow is named beside the system.
CLASSICAL = """
Num = Numa
"""

STEPHANUS = """
Alc. maj = Greater Alcibiades
Apol = Apology
Ax = Axiochus
Charm = Charmides
Crat = Cratylus
Def = Definitions
Euthyd = Euthydemus
Euthyphr = Euthyphro
Gorg = Gorgias
Hipparch = Hipparchus
Hipp. maj = Greater Hippias
Hipp. min = Lesser Hippias
Lach = Laches
Leg = Laws
Menex = Menexenus
Min = Minos
Parm = Parmenides
Phaed = Phaedo
Phaedr = Phaedrus
Phileb = Philebus
Pol = Statesman
Prot = Protagoras
Resp = Republic
Soph = Sophist
Symp = Symposium
Theaet = Theaetetus
Tim = Timaeus
"""

PHILO = """
Abr = Abraham
Aet = Eternity
Agr = Agriculture
Anim = Animals
Cher = Cherubim
Conf = Confusion
Congr = Preliminary Studies
Contempl = Contemplative Life
Decal = Decalogue
Deo = God
Det = Worse
Deus = Unchangeable
Ebr = Drunkenness
Exsecr = Curses
Flacc = Flaccus
Fug = Flight
Gig = Giants
Her = Heir
Hypoth = Hypothetica
Ios = Joseph
Legat = Embassy
Migr = Migration
Mos = Moses
Mut = Names
Opif = Creation
Plant = Planting
Post = Posterity
Praem = Rewards
Prob = Good Person
Prov = Providence
QE = Questions and Answers on Exodus
QG = Questions and Answers on Genesis
Sacr = Sacrifices
Sobr = Sobriety
Somn = Dreams
Spec = Special Laws
Spec. Leg = Special Laws
Virt = Virtues
"""

JOSEPHUS = """
Vita = Life
C. Ap = Against Apion
Ag. Ap = Against Apion
A.J = Jewish Antiquities
AJ = Jewish Antiquities
Ant = Jewish Antiquities
B.J = Jewish War
BJ = Jewish War
J.W = Jewish War
JW = Jewish War
"""

DIELS_KRANZ = """
DK = Diels-Kranz
"""

PSEUDEPIGRAPHA = """
Ahiqar = Ahiqar
Ant. bib. = Liber antiquitatum biblicarum
Apoc. Ab. = Apocalypse of Abraham
Apoc. Adam = Apocalypse of Adam
Apoc. Dan. = Apocalypse of Daniel
Apoc. El. (C) = Coptic Apocalypse of Elijah
Apoc. El. (H) = Hebrew Apocalypse of Elijah
Apoc. Ezek. = Apocryphon of Ezekiel
Apoc. Mos. = Apocalypse of Moses
Apoc. Sedr. = Apocalypse of Sedrach
Apoc. Zeph. = Apocalypse of Zephaniah
Apoc. Zos. = History of the Rechabites
Apocr. Ezek. = Apocryphon of Ezekiel
Aris. Ex. = Aristeas the Exegete
Aristob. = Aristobulus
Artap. = Artapanus
As. Mos = Assumption of Moses
Ascen. Isa. = Ascension of Isaiah
2 Bar. = 2 Baruch
3 Bar. = 3 Baruch
4 Bar. = 4 Baruch
Bib. Ant. = Liber antiquitatum biblicarum
Bk. Noah = Book of Noah
Cav. Tr. = Cave of Treasures
Cl. Mal. = Cleodemus Malchus
Dem. = Demetrius the Chronographer
El. Mod. = Eldad and Modad
1 En. = 1 Enoch
2 En. = 2 Enoch
3 En. = 3 Enoch
Eup. = Eupolemus
Ezek. Trag. = Ezekiel the Tragedian
4 Ezra = Fourth Ezra
5 Apoc. Syr. Pss. = Five Apocryphal Syriac Psalms
Gk. Apoc. Ezra = Greek Apocalypse of Ezra
Hec. Ab. = Hecataeus of Abdera
Hel. Syn. Pr. = Hellenistic Synagogal Prayers
Hist. Jos. = History of Joseph
Hist. Rech. = History of the Rechabites
Jan. Jam. = Jannes and Jambres
Jos. Asen. = Joseph and Aseneth
Jub = Jubilees
LAB = Liber antiquitatum biblicarum
LAE = Life of Adam and Eve
Lad. Jac. = Ladder of Jacob
Let. Aris. = Letter of Aristeas
Liv. Pro. = Lives of the Prophets
Lost Tr. = Lost Tribes
3 Macc. = 3 Maccabees
4 Macc. = 4 Maccabees
5 Macc. = 5 Maccabees
Mart. Ascen. Isa. = Martyrdom and Ascension of Isaiah
Mart. Isa. = Martyrdom of Isaiah
Odes Sol. = Odes of Solomon
PJ = 4 Baruch
Ph. E. Poet = Philo the Epic Poet
Pr. Jac. = Prayer of Jacob
Pr. Jos. = Prayer of Joseph
Pr. Man. = Prayer of Manasseh
Pr. Mos. = Prayer of Moses
Ps.-Eup. = Pseudo-Eupolemus
Ps.-Hec. = Pseudo-Hecataeus
Ps.-Orph. = Pseudo-Orpheus
Ps.-Philo = Liber antiquitatum biblicarum
Ps.-Phoc. = Pseudo-Phocylides
Pss Sol = Psalms of Solomon
Pss. Sol. = Psalms of Solomon
Ques. Ezra = Questions of Ezra
Rev. Ezra = Revelation of Ezra
Sib Or = Sibylline Oracles
Sib. Or. = Sibylline Oracles
Syr. Men. = Sentences of the Syriac Menander
T. 12 Patr. = Testaments of the Twelve Patriarchs
T. Ash. = Testament of Asher
T. Benj. = Testament of Benjamin
T. Dan = Testament of Dan
T. Gad = Testament of Gad
T. Iss. = Testament of Issachar
T. Jos. = Testament of Joseph
T. Jud. = Testament of Judah
T. Levi = Testament of Levi
T. Naph. = Testament of Naphtali
T. Reu. = Testament of Reuben
T. Sim. = Testament of Simeon
T. Zeb. = Testament of Zebulun
T. 3 Patr. = Testaments of the Three Patriarchs
T. Ab. = Testament of Abraham
T. Isaac = Testament of Isaac
T. Jac. = Testament of Jacob
T. Adam = Testament of Adam
T. Hez. = Testament of Hezekiah
T. Job = Testament of Job
T. Mos. = Testament of Moses
T. Sol. = Testament of Solomon
Theod. = Theodotus
Treat. Shem = Treatise of Shem
Vis. Ezra = Vision of Ezra
Vis. Isa. = Ascension of Isaiah
"""

CD = """
CD = the Damascus Document
"""

BIBLICAL = """
Gen = Genesis
Exod = Exodus
Lev = Leviticus
Num = Numbers
Deut = Deuteronomy
Josh = Joshua
Judg = Judges
Ruth = Ruth
1 Sam = First Samuel
2 Sam = Second Samuel
1 Kgdms = First Kingdoms
2 Kgdms = Second Kingdoms
1 Kgs = First Kings
2 Kgs = Second Kings
3 Kgdms = Third Kingdoms
4 Kgdms = Fourth Kingdoms
1 Chr = First Chronicles
2 Chr = Second Chronicles
Ezra = Ezra
Neh = Nehemiah
Esth = Esther
Job = Job
Ps = Psalm
Pss = Psalms
Prov = Proverbs
Eccl = Ecclesiastes
Qoh = Ecclesiastes
Song = Song of Songs
Cant = Song of Songs
Isa = Isaiah
Jer = Jeremiah
Lam = Lamentations
Ezek = Ezekiel
Dan = Daniel
Hos = Hosea
Joel = Joel
Amos = Amos
Obad = Obadiah
Jonah = Jonah
Mic = Micah
Nah = Nahum
Hab = Habakkuk
Zeph = Zephaniah
Hag = Haggai
Zech = Zechariah
Mal = Malachi
Matt = Matthew
Mark = Mark
Luke = Luke
John = John
Acts = Acts
Rom = Romans
1 Cor = First Corinthians
2 Cor = Second Corinthians
Gal = Galatians
Eph = Ephesians
Phil = Philippians
Col = Colossians
1 Thess = First Thessalonians
2 Thess = Second Thessalonians
1 Tim = First Timothy
2 Tim = Second Timothy
Titus = Titus
Phlm = Philemon
Heb = Hebrews
Jas = James
1 Pet = First Peter
2 Pet = Second Peter
1 John = First John
2 John = Second John
3 John = Third John
Jude = Jude
Rev = Revelation
Tob = Tobit
Jdt = Judith
Add Esth = Additions to Esther
Wis = Wisdom of Solomon
Sir = Sirach
Bar = Baruch
Ep Jer = Epistle of Jeremiah
Add Dan = Additions to Daniel
Pr Azar = Prayer of Azariah
Sg Three = Song of the Three Young Men
Sus = Susanna
Bel = Bel and the Dragon
1 Macc = First Maccabees
2 Macc = Second Maccabees
3 Macc = Third Maccabees
4 Macc = Fourth Maccabees
1 Esd = First Esdras
2 Esd = Second Esdras
Pr Man = Prayer of Manasseh
Ps 151 = Psalm one hundred fifty-one
"""

BARE_AUTHORS = """
Cassius Dio = Cassius Dio,
Livy = Livy,
"""

# The named scrolls, by their letters.
SCROLLS = """
Ps = the Psalms Scroll
MMT = Miqsat Ma'ase ha-Torah
H = the Thanksgiving Hymns
M = the War Scroll
S = the Rule of the Community
"""

SYSTEMS = [("classical", CLASSICAL, "number"), ("stephanus", STEPHANUS, "stephanus"), ("philo", PHILO, "number"), ("josephus", JOSEPHUS, "number"), ("diels_kranz", DIELS_KRANZ, "fragment"), ("pseudepigrapha", PSEUDEPIGRAPHA, "number"), ("damascus_document", CD, "number"), ("biblical", BIBLICAL, "number"), ("bare_author", BARE_AUTHORS, "number")]


def pairs(lines: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" = ", 1)) for x in lines.strip().splitlines()]


def vocabulary() -> list[tuple[str, int, int, str, str, str]]:
    """(system, priority, ordinal, siglum, spoken, shape) of all fixed sigla."""
    return [(system, p, o, siglum, spoken, shape) for p, (system, lines, shape) in enumerate(SYSTEMS) for o, (siglum, spoken) in enumerate(pairs(lines))]
