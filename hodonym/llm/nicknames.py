"""Short and pet forms of given names."""

# Romanian and Hungarian pet forms (folded) and the given names that they may stand for.
PET_FORMS = {
    "adi": "adrian", "ana": "anastasia", "anda": "alexandra", "andy": "andrei", "bebe": "gheorghe", "cati": "ecaterina", "catinca": "ecaterina",
    "costache": "constantin", "costel": "constantin", "costica": "constantin", "culae": "nicolae", "culita": "nicolae", "dinu": "constantin",
    "dita": "dumitru", "doru": "teodor", "edi": "eduard", "emil": "emilian", "fane": "stefan", "fanica": "stefan", "fanel": "stefan",
    "florica": "florin", "frosa": "eufrosina", "gabi": "gabriel", "gavrila": "gavril", "geo": "george", "geta": "georgeta", "ghita": "gheorghe",
    "gica": "gheorghe", "gigi": "gheorghe", "gelu": "gheorghe", "george": "gheorghe", "gogu": "gheorghe", "gore": "grigore", "grig": "grigore",
    "grigoras": "grigore", "iancu": "ion", "ica": "ioana", "ileana": "elena", "ilinca": "elena", "ionel": "ion", "ionica": "ion",
    "ionut": "ion", "iorgu": "gheorghe", "jan": "ion", "janos": "ion", "jeni": "eugenia", "jenica": "eugen", "joska": "jozsef", "joco": "jozsef",
    "lae": "nicolae", "lambe": "haralambie", "lenuta": "elena", "leni": "elena", "lica": "vasile", "lina": "carolina", "lorin": "laurentiu",
    "luta": "elena", "madalina": "magdalena", "manole": "emanoil", "marga": "margareta", "margit": "margareta", "maricica": "maria",
    "marioara": "maria", "mihai": "mihail", "misu": "mihail", "mihaita": "mihail", "mircica": "mircea", "mitica": "dumitru", "mitru": "dumitru",
    "mitu": "dumitru", "nae": "nicolae", "nela": "cornelia", "nelu": "ion corneliu", "nicu": "nicolae", "nicusor": "nicolae", "niculae": "nicolae",
    "nuta": "ion", "ovi": "ovidiu", "petrica": "petre", "petru": "petre", "pista": "istvan", "pompi": "pompiliu", "puiu": "ion", "radita": "rada",
    "raducu": "radu", "roza": "rozalia", "ruxanda": "ruxandra", "safta": "elisabeta", "sanda": "alexandra ruxandra smaranda", "sandor": "alexandru",
    "sandu": "alexandru", "seba": "sebastian", "simi": "simion", "sorica": "sorin", "tache": "dumitru", "tasia": "anastasia", "tase": "anastasie",
    "tavi": "octavian", "teo": "teodor", "tica": "valentin constantin", "tilda": "matilda", "tina": "leontina valentina cristina", "toader": "teodor",
    "tudorel": "tudor", "tudorica": "tudora", "vali": "valentin", "vera": "veronica", "viorica": "viorel", "vasilica": "vasile", "veta": "elisabeta",
    "vica": "victoria", "vili": "wilhelm", "willi": "wilhelm", "willy": "wilhelm", "zamfir": "zamfira",
}


def givens(word: str) -> list[str]:
    """The given names for which ``word`` may stand, without itself."""
    return PET_FORMS.get(word, "").split()
