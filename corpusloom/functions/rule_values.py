"""Words, phrases and patterns that relabelling rules know.

Fixed values, one item each, as the rules state them: a class such as [eé] stands for either sign, a question mark for a sign
that may be missing. How they are put together is told in `rules`.
"""

from __future__ import annotations

SPEED_UNITS = (
    "km/h", "m/s", "mph", "mi/h", "km/s", "km·h", "kn", "nœud", "noeud", "noeuds", "knot", "mach", "baud", "bauds", "tr/min", "rpm", "Hz", "kHz", "MHz", "GHz", "l/s",
    "m³/s", "m3/s", "L/min",
)
COUNTABLE = (
    "personne", "personnes", "habitant", "habitants", "individu", "individus", "victime", "victimes", "bless[eé]", "bless[eé]s", "mort", "morts", "décédé", "décédés",
    "tu[eé]", "tu[eé]s", "soldat", "soldats", "militaire", "militaires", "manifestant", "manifestants", "gréviste", "grévistes", "syndicaliste", "syndicalistes", "patient",
    "patients", "malade", "malades", "infirmier", "infirmiers", "médecin", "médecins", "[eé]l[eè]ve", "[eé]l[eè]ves", "[eé]tudiant", "[eé]tudiants", "enfant", "enfants",
    "homme", "hommes", "femme", "femmes", "adulte", "adultes", "jeune", "jeunes", "mineur", "mineurs", "citoyen", "citoyens", "r[eé]fugi[eé]", "r[eé]fugi[eé]s", "d[eé]tenu",
    "d[eé]tenus", "employ[eé]", "employ[eé]s", "salari[eé]", "salari[eé]s", "ouvrier", "ouvriers", "travailleur", "travailleurs", "agriculteur", "agriculteurs",
    "p[eê]cheur", "p[eê]cheurs", "voiture", "voitures", "v[eé]hicule", "v[eé]hicules", "camion", "camions", "bus", "car", "cars", "navire", "navires", "bateau", "bateaux",
    "avion", "avions", "a[eé]ronef", "drone", "drones", "logement", "logements", "appartement", "appartements", "maison", "maisons", "b[aâ]timent", "b[aâ]timents",
    "entreprise", "entreprises", "soci[eé]t[eé]", "soci[eé]t[eé]s", "[eé]tablissement", "[eé]tablissements", "pays", "r[eé]gion", "r[eé]gions", "ville", "villes", "commune",
    "communes", "d[eé]partement", "millier", "milliers", "million", "millions", "milliard", "milliards", "billion", "billions", "centaine", "centaines", "dizaine",
    "dizaines", "douzaine", "douzaines", "vingtaine", "trentaine", "quarantaine", "cinquantaine", "soixantaine", "point", "points", "but", "buts", "essai", "essais", "set",
    "sets", "match", "matches", "cas", "incident", "incidents", "[eé]v[eè]nement", "[eé]v[eè]nements", "fois", "occurrence", "occurrences", "exemple", "exemples", "disparu",
    "disparus",
)
APPROXIMATE = (
    "plusieurs", "quelques", "de nombreux", "de nombreuses", "une vingtaine", "une dizaine", "une douzaine", "une trentaine", "une quarantaine", "une cinquantaine",
    "une centaine", "des milliers", "des centaines", "des dizaines", "des millions", "des milliards", "plus d[eu]", "moins d[eu]", "environ", "près de", "autour de",
    "au moins", "au plus", "à peine",
)
PHYSICAL_UNITS = (
    "kg", "g", "mg", "t", "tonne", "tonnes", "km", "m", "cm", "mm", "nm", "km²", "hectare", "ha", "m²", "m³", "°C", "°F", "°K", "kelvin", "celsius", "an", "ans", "ann[eé]e",
    "ann[eé]es", "mois", "jour", "jours", "semaine", "semaines", "heure", "heures", "minute", "minutes", "seconde", "secondes", "watt", "watts", "kW", "MW", "GW", "volt",
    "ampère", "joule", "cal", "kcal", "litre", "litres", "cl", "ml", "dl", "bit", "octet", "Mo", "Go", "To", "Ko",
)
NUMBER_WORDS = (
    "z[eé]ro", "un", "une", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "dix-sept",
    "dix-huit", "dix-neuf", "vingt", "trente", "quarante", "cinquante", "soixante", "soixante-dix", "quatre-vingt", "quatre-vingts", "cent", "cents", "mille", "plusieurs",
    "quelques", "nombreux", "nombreuses",
)
RATE_CONTEXT = (
    "taux", "croissance", "inflation", "ch[oô]mage", "emploi", "fertili", "natalit", "mortalit", "variation", "[eé]volution", "progression", "hausse", "baisse", "rendement",
    "retour", "r[eé]mun[eé]ration", "int[eé]r[eê]t", "dividende", "performance", "efficacit", "productivit", "rencherissement", "r[eé]enchérissement",
)
MACRO_ACRONYMS = (
    "PIB", "PNB", "PPA", "IDH", "IPC", "IPP", "PMI", "ISM", "CAC", "CAF", "FAB", "TVA", "RSA", "SMIG", "SMIC",
)
VAGUE_RATES = (
    "niveau", "niveaux", "seuil", "palier", "indice", "valeur", "degr[eé]", "rang",
)
DOCUMENT_WORDS = (
    "donn[eé]e", "donn[eé]es", "liste", "listes", "fichier", "fichiers", "rapport", "rapports", "bulletin", "bulletins", "note", "notes", "document", "documents", "acte",
    "actes", "formulaire", "formulaires", "d[eé]cret", "d[eé]crets", "arr[eê]t[eé]", "arr[eê]t[eé]s", "proc[eè]s-verbal", "ordonnance", "circulaire", "m[eé]morandum",
    "registre", "registres", "archive", "archives", "dossier", "dossiers", "contrat", "contrats", "accord", "accords", "trait[eé]", "convention",
)
SIZES = (
    "petite", "petites", "moyenne", "moyennes", "grande", "grandes", "PME", "TPE",
)
NOTION_ADJECTIVES = (
    "majeure", "majeures", "mineure", "mineures", "importante", "importantes", "fondamentale", "fondamentales", "essentielle", "essentielles", "principale", "principales",
    "secondaire", "secondaires", "multiple", "multiples", "diverse", "diverses", "positive", "positives", "n[eé]gative", "n[eé]gatives", "fausse", "fausses", "vraie",
    "vraies", "nouvelle", "nouvelles", "ancienne", "anciennes", "moderne", "modernes", "contemporaine", "contemporaines", "complexe", "complexes", "simple", "simples",
    "claire", "claires", "obscure", "obscures",
)
VAGUE_DOCTRINES = (
    "approche", "approches", "ligne", "lignes", "m[eé]thode", "m[eé]thodes", "voie", "voies", "strat[eé]gie", "strat[eé]gies", "tendance", "tendances", "logique",
    "logiques", "vision", "visions", "position", "positions", "lecture", "lectures", "interpr[eé]tation", "interpr[eé]tations", "paradigme?s?", "mod[eè]le?s?", "cadre",
    "cadres", "doctrine", "option", "options",
)
QUANTITY_WORDS = (
    "un", "une", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente",
    "quarante", "cinquante", "soixante", "cent", "cents", "mille", "million", "millions", "milliard", "milliards", "billion", "billions", "dizaine", "dizaines", "centaine",
    "centaines", "cinquantaine", "cinquantaines", "quelque", "quelques", "plusieurs", "nombreux", "nombreuses", "trentaine", "trentaines", "quarantaine", "quarantaines",
    "premier", "premiers", "première", "premières", "dernier", "derniers", "dernière", "dernières", "demi", "demis", "quart", "quarts", "tiers",
)
WORKS_OF_ART = (
    "film", "films", "œuvre", "œuvres", "oeuvre", "oeuvres", "lettres", "livre", "livres", "chanson", "chansons", "album", "albums", "série", "séries", "émission",
    "émissions", "morceaux musicaux", "classiques",
)
NOTIONS = (
    "notion", "notions", "idée", "idées", "sens", "vision", "existence", "influence", "mémoire", "signification", "conscience", "nature", "essence", "intention",
    "particularité", "essentiel", "besoin", "vérité", "réalité", "pensée", "liberté", "justice", "dignité", "équité", "valeur", "principe", "concept",
)
PROCESSES = (
    "cycle", "cycles", "rythme", "algorithme", "algorithmes", "transmission", "diffusion", "évolution", "convergence", "sampling",
)
FIELDS = (
    "chimie", "physique", "biologie", "informatique", "mathématique", "mathématiques", "algèbre", "médecine", "électronique", "astronomie", "géologie", "linguistique",
    "économie", "sociologie",
)
RULE_WORDS = (
    "instruction", "instructions", "conseil", "conseils", "protocole", "procédure", "procédures",
)
INFRA_PLACES = (
    "poste", "base", "bureaux", "bureau", "batiment", "batiments", "btiment", "btiments", "terminal", "centrale", "infrastructure", "structures", "installation",
    "installations", "construction", "constructions", "escalier", "escaliers", "frontiere", "frontieres", "frontire", "frontires",
)
INFRA_OBJECTS = (
    "barricade", "barricades", "la chemine", "chemine", "la cheminee", "cheminee", "clture", "clture de scurit", "barrire", "barrires", "barrires de scurit", "cloture",
    "barriere", "barrieres",
)
TOOL_OBJECTS = (
    "electrons", "lectrons", "protons", "neutrons", "photons", "atomes", "molecules", "molcules", "ions", "isotopes", "logithque", "logiteque", "portail", "controles",
    "contrle", "mainframes", "deliberation", "dlibration", "technologie", "technologies", "algorithme", "algorithmes", "application", "applications", "piano", "guitare",
    "violon", "trompette", "saxophone", "baguettes",
)
TOOL_WEAPONS = (
    "traquenard", "traquenards", "piege", "pieges", "pige", "piges", "trappe", "trappes",
)
ABSTRACT_NOUNS = (
    "dommage", "dommages", "pr[eé]judice", "pr[eé]judices", "perte", "pertes", "co[uû]t", "co[uû]ts", "risque", "risques", "niveau", "niveaux", "d[eé]ficit", "exc[eé]dent", "impact",
    "impacts", "effet", "effets", "cons[eé]quence", "cons[eé]quences", r"moyen\b", r"moyenne\b", "am[eé]lioration", "d[eé]gradation",
)
PERSON_PREFIXES = (
    "policier", "parlementaire", "senateur", "snateur", "congresiste", "conseiller", "ministre", "secour", "course", "coureur", "autoroute", "autorisation",
)
INSTITUTION_PREFIXES = (
    "assemblee nationale", "assemblee generale", "senat", "congres", "chambre des lords", "chambre des deputes", "chambre haute", "chambre basse", "diete", "bundestag",
    "bundesrat", "legislatif", "tribunal", "cour d appel", "cour de cassation", "cour constitutionnelle", "cour supreme", "cour internationale", "cour de justice",
    "parquet", "judiciaire", "police", "gendarmerie", "forces de l ordre", "forces de police", "forces de securite", "forces armees", "forces aeriennes", "forces afghanes",
    "forces speciales", "forces internationales", "forces navales", "forces terrestres", "armee", "marines", "marine nationale", "marine americaine", "marine militaire",
    "marine royale", "prefecture de police", "prefecture", "services de police", "autorites", "agents de securite", "mairie", "municipalite", "conseil municipal",
    "conseil departemental", "conseil regional", "conseil general", "conseil des ministres", "conseil de securite", "commission", "comite", "syndicat",
    "federation syndicale", "confederation", "coalition", "regime", "securite sociale", "service public", "services publics", "gouvernement", "parlement", "ministere",
)
INSTITUTION_ROOTS = (
    "gouvernement", "parlement", "senat", "congres", "assemblee", "tribunal", "parquet", "chancellerie", "gendarmerie", "prefecture", "administration", "executif",
    "legislatif", "judiciaire", "mairie", "syndicat", "coalition", "regime", "commission", "conseil des ministres", "conseil de securite", "conseil general",
    "conseil municipal", "conseil regional", "conseil departemental", "chambre des representants", "chambre haute", "chambre des deputes",
)
QUALIFIERS = (
    "europeen", "francais", "francs", "france", "americain", "britannique", "anglais", "allemand", "internationa", "mondial", "federal", "federaux", "supreme", "suprema",
    "nations unies", "onu ", "europe", "de l onu", "des nations", "de paris", "constitutionnel", " de ", " des ", " du ", " d ",
)
STATE_ADJECTIVES = (
    "totale?", "collective?", "sanitaire", "sanitaires", "majeure", "majeures", "grave", "graves", "critiqu[eé]", "profonde", "profondes", "s[eé]v[eè]re", "s[eé]v[eè]res",
    "alarmante?", "pr[eé]occupante?", "instable", "instables", "volatile", "fragile", "fragiles", "tendu", "tendue", "tendues", "acute?", "chronique", "chroniques", "end[eé]mique",
    "end[eé]miques", "structurelle?", "conjoncturelle?", "résiduelle?", "transitoire",
)
GARBAGE = (
    "quelque", "grande?", "essentiel[le]?s?", "bas[se]?", "concentration", "point", "dose", "faible", "élevé[e]?", "haut[e]?", "peu", "beaucoup", "très", "assez", "trop",
    "de", "du", "des", "le", "la", "les", "un", "une",
)
ANY_UNITS = (
    "km[²2]?", "m[²2³3]", "cm", "mm", "ha", "kg", "mg", "tonnes?", "litres?", "ml", "cl", "dl", "nœuds?", "mach", "°C", "°F", "kelvin", "[kMGT]Hz", "[kMGT]W", "watts?",
    "dB", "decibels?", "volts?", "ampères?", "ohms?", "bits?", "octets?", "[KMGTP]o", "méga", "giga", "téra", "péta", "lieues?", "mètres?", "kilomètres?", "centimètres?",
    "millimètres?",
)
COUNT_UNITS = (
    r"buts?\b", r"goals?\b", r"victoires?\b", r"morts?\b", r"bless\S*s?\b", r"victimes?\b", r"membres?\b", r"d\S*put\S*s?\b", r"s\S*nateurs?\b", r"t\S*moins?\b",
    r"experts?\b", r"voix\b", r"articles?\b", r"v\S*hicules?\b", r"voitures?\b", r"avions?\b", r"soldats?\b", r"manifestants?\b", r"pays\b", r"villes?\b", r"entreprises?\b",
    r"rencontres?\b", r"matchs?\b", r"participants?\b", r"candidats?\b",
)
ORDINALS = (
    "premier", "premi.re", "deuxi.me", "troisi.me", "quatri.me", "cinqui.me", "sixi.me", r"\d+e(?:r|re)?\b", r"i.me\b",
)
MEASURE_UNITS = (
    r"\bkg\b", r"\bmg\b", "tonnes?", r"centim\S*tres?", r"millim\S*tres?", r"kilom\S*tres?\b", r"m\S*tres?\b", r"\bcm\b", r"\bmm\b", r"\bkm\b", r"\bm\b", "hectares?",
    r"\bha\b", r"pieds?\b", r"pouces?\b", r"yards?\b", r"litres?\b", r"\bml\b", r"\bGo\b", r"\bMo\b", r"\bKo\b", r"\bGB\b", r"\bMB\b", r"\bKB\b", "GiB", "MiB",
    r"megapixels?\b", r"pixels?\b", r"\bmp\b", r"\bHz\b", r"\bkHz\b", r"\bMHz\b", r"\bGHz\b", r"volts?\b", r"watts?\b", r"\bdB\b",
)
NUMBER_PHRASES = (
    "z.ro", "un", "une", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt",
    "trente", "quarante", "cinquante", "soixante", "cent", "mille", "une dizaine", "une vingtaine", "une trentaine", "une quarantaine", "une cinquantaine",
    "une soixantaine", "une centaine", "quelques",
)
RATE_UNITS = ("km/h", "m/s", "mph", "buts?/match", "points?/match", "tr/min", "rpm", "MB/s", "Mbps", "Gbps")
RATE_PERIODS = ("heure", "jour", "semaine", "mois", "an", "rencontre", "match", "km")
ABSTRACT_KINDS = ("mat[eé]riel", "moral", "humain", "financier", "[eé]conomique")
ADJECTIVE_ENDINGS = ("al", "el", "if", "ive", "ique", "aire", "oire", "iste", "ant", "ent", "eux", "euse")

# What a law, or a disease, may begin with, each behind an article or none.
ARTICLES = ("le ", "la ", "les ", "l'")
LAWS = (
    (("traité", "trait"), ("de ", "d'", "du ", "sur ")),
    (("édit", "edit"), ("de ", "d'", "du ")),
    (("loi",), ("sur ", "de ", "du ", "Hadopi", "Taubira", "Veil", "Évin", "Evin", "Toubon", "Gayssot")),
    (("décret", "decret"), ("de ", "d'", "du ", "sur ", "n°")),
    (("constitution",), ("",)),
    (("convention",), ("de ", "d'", "du ", "sur ", "européenne")),
    (("accord", "accords"), ("de ", "d'", "du ", "sur ")),
    (("pacte",), ("de ", "d'", "du ")),
    (("charte",), ("de ", "d'", "du ", "des ")),
    (("protocole",), ("de ", "d'", "du ", "sur ")),
    (("directive",), ("",)),
    (("ordonnance",), ("de ", "d'", "du ")),
    (("règlement",), ("de ", "d'", "du ", "sur ", "général")),
    (("déclaration", "declaration"), ("de ", "d'", "du ", "des ", "universelle")),
    (("Code",), ("civil", "pénal", "du travail", "de commerce")),
)
LAW_BEGINNINGS = ("concordat", "armistice")
LAW_NAMES = ("Magna Carta", "Bill of Rights", "Habeas Corpus", "accord de paix")
LAW_WHOLE = ("constitution", "nouvelle constitution")
LAW_ANYWHERE = ("loi sur la réduction",)
DISEASES = ("covid-19", "covid", "sars-cov-2", "ebola", "sras", "sars", "vih", "sida", "mpox", "zika", "h1n1", "h5n1")
DISEASES_WITH_MORE = ("grippe", "peste", "cancer", "diabète")
DISEASES_ALONE = ("choléra", "tuberculose", "variole", "paludisme", "rougeole", "dengue", "coqueluche", "polio", "poliomyélite")
DISEASES_OF = (
    (("maladie",), ("de ", "d'", "du ")),
    (("virus",), ("Ebola", "Zika", "de la ", "du ")),
    (("syndrome",), ("de ", "d'", "du ")),
    (("fièvre",), ("jaune", "typhoïde", "hémorragique", "de ")),
)
DISEASE_BEGINNINGS = ("sclérose", "hépatite", "méningite")
