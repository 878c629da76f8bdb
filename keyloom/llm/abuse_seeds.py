"""Hand-labelled sentences that start the classifier, and the fixed lists of its reader.

All values here are fixed values. ``{n}`` stands for a name or group; the trainer fills it.
"""

#: Insults, threats, degradation of groups, explicit passages.
ABUSIVE = [
    "{n} is a stupid idiot", "you are a worthless piece of shit", "fuck you {n}", "fuck off", "go to hell", "what a pathetic loser", "shut up you moron", "you fucking cunt", "{n} is a filthy whore",
    "you stupid cretin", "you dumbass", "you are an ugly fat asshole", "dumb shithead", "disgusting freak", "you idiots", "what a twat", "you slut", "full of shit", "piss off", "eat shit",
    "kill yourself", "I hope you die", "I will kill you", "we will find you and kill you", "I know where you live", "should be shot", "should be hanged", "watch your back or we cut your throat",
    "we are going to beat you until you stop breathing", "I am going to hurt you", "you will regret this, we know your house", "burn in hell", "I will break your legs", "you deserve to be raped",
    "I hate all {n}", "{n} are subhuman", "all {n} are criminals and should be deported", "{n} are an inferior race", "exterminate all {n}", "{n} do not deserve to live", "{n} are dirty animals",
    "get rid of the {n}", "{n} are vermin", "{n} are parasites", "{n} are scum", "the {n} are trash", "{n} go back to where you came from", "women are stupid and belong in the kitchen", "filthy {n}",
    "hot milf sucks dick", "cum on her tits", "xxx porn", "hardcore porn clips", "horny sluts", "suck my cock", "lick her pussy", "he fucked her hard", "naked girls on webcam", "anal sex", "blowjob", "nude pics", "big boobs and ass pics",
    "du dummkopf", "du schlampe", "du missgeburt", "dumme fotze", "du schwuchtel", "scheisse", "verdammter idiot", "putain d'enculé", "abruti", "connasse", "pétasse", "bâtard", "gilipollas", "maricón", "idiota inútil", "coño",
    "дурак", "тупой ублюдок", "блядь", "скотина", "сволочь", "バカ", "アホ", "ブス", "ابن العاهرة", "حيوان قذر",
    "du arschloch", "halt die fresse", "fick dich", "so ein vollidiot", "verpiss dich du hurensohn", "du wichser", "drecksau", "alle {n} raus, das dreckspack", "ungeziefer",
    "va te faire foutre", "sale pute", "connard", "ferme ta gueule", "nique ta mère", "espèce de con", "salope", "sale merde",
    "hijo de puta", "cállate imbécil", "vete a la mierda", "eres un cabrón", "maldita zorra", "pendejo", "puta madre",
    "ты идиот", "мразь", "сдохни тварь", "пошёл на хуй", "сука", "урод и дебил", "заткнись",
    "يا كلب", "ابن الكلب", "اخرس يا حمار", "يا غبي", "حقير",
    "馬鹿野郎", "死ね", "消えろ", "くたばれ", "クズ", "ゴミ野郎", "気持ち悪いブス",
]

#: Words of abuse, each learned in the phrases of ``PHRASES``.
INSULTS = [
    "idiot", "moron", "imbecile", "cretin", "halfwit", "dumbass", "dickhead", "asshole", "arsehole", "bastard", "bitch", "cunt", "prick", "wanker", "twat", "scumbag", "shithead",
    "loser", "retard", "whore", "slut", "douchebag", "motherfucker", "cocksucker", "dimwit", "liar", "coward", "swine", "pervert", "tosser", "bellend", "dipshit", "jackass",
]
SCORNS = ["stupid", "ugly", "fat", "filthy", "disgusting", "worthless", "pathetic", "brainless", "useless", "bloody", "fucking", "lying", "dumb"]
PHRASES = ["you {a} {w}", "{n} is a {a} {w}", "{n} you {w}", "they are {a} {w}s", "such a {a} {w}", "what a {w}"]

#: Harmless words that fill the same phrases, so that the phrases themselves prove nothing.
HARMLESS = [
    "teacher", "doctor", "friend", "house", "song", "garden", "book", "city", "car", "dog", "student", "engineer", "player", "cook", "neighbour", "window", "river", "story", "film",
    "poem", "museum", "bridge", "village", "writer", "sister", "table", "holiday", "meal", "team", "horse", "picture", "letter", "number",
]
MILD = ["nice", "old", "young", "tall", "famous", "good", "quiet", "new", "small", "honest", "busy", "clever", "kind"]

#: Neutral, scientific and quoted mention, and plain nonsense.
NEUTRAL = [
    "the word is considered vulgar", "the word has several meanings", "the term has a technical meaning in law", "it has a long history", "he has a legal duty", "the slur is recorded in a dictionary of slang", "racial slurs are discussed in the article", "he quoted the insult in court", "the term \"idiot\" was once used in medicine", "\"bastard\" meant a child of unmarried parents",
    "imbecile was a clinical category in older texts", "sexual selection in birds", "the sex ratio of the population is even", "sexual health is taught at school", "breast feeding is recommended", "breast cancer is treated at the hospital",
    "a bitch is a female dog", "a cock is a male bird", "the great tit is a small bird", "the donkey, also called ass", "the bastard sword is a weapon", "rape seed oil", "the penis of the male is short", "female genitalia are described by the anatomist",
    "the film contains scenes of nudity", "the article discusses pornography law", "naked eye", "the court found him guilty of murder", "the rapist was sentenced to prison", "he was shot in the war", "the murder victims were buried", "the poem describes hell",
    "pest control of rats and cockroaches", "a parasite of sheep", "vermin were controlled with traps", "animals are kept in the zoo", "trash is collected on monday", "the disease killed many cattle", "he died slowly of his wounds", "she died alone in 1832",
    "hate crimes are recorded by the police", "racism was studied by sociologists", "women were allowed to vote from 1919", "the temple was torn down and rebuilt", "people were driven out by the flood", "a useless patent", "the ugly duckling is a tale", "fat and protein content", "the dog is a filthy animal in the fable",
    "test test test", "i was here", "hello world", "my friend is cool", "this page is boring", "blah blah blah", "qwerty qwerty",
    "men and women worked in the factory", "jews and christians lived in the quarter", "the muslim community built a mosque", "gay rights were debated in parliament", "immigrants from the south settled here", "black and white photographs", "the disabled were cared for in the hospital",
    "the {n} people speak their own language", "the {n} are a people of the north", "{n} was a writer", "{n} was born in the city", "this is only a stub", "a council of the town", "she was the daughter of a farmer", "they are found on the coast", "you can see the castle from the road", "the town is run by a mayor",
    "das wort wird als schimpfwort gebraucht", "ist ein dorf im kreis", "die bewohner sind bauern und fischer", "der hund und das schwein", "le mot est une insulte ancienne", "est un village de la commune", "les maisons sont de la pierre du pays", "le chien est un animal",
    "es un municipio de la provincia", "un puente de los romanos", "los habitantes son de la comarca", "la rata negra es un roedor", "это большой город на реке", "крыса серая вид грызунов", "население города", "الكلب حيوان أليف", "عدد السكان", "犬は動物である", "馬と鹿の図", "町の人口",
]

#: Terms that name groups; swapped for one another when scores are compared.
IDENTITY_TERMS = [
    "women", "men", "girls", "boys", "jews", "jewish", "muslims", "muslim", "christians", "christian", "catholics", "hindus", "buddhists", "atheists", "gays", "gay", "lesbians", "lesbian",
    "transgender", "blacks", "black", "whites", "white", "asians", "asian", "africans", "african", "arabs", "arab", "immigrants", "migrants", "refugees", "foreigners", "gypsies", "roma",
    "disabled", "cripples", "old", "poor", "mexicans", "chinese", "indians", "germans", "french", "russians", "turks", "people", "minority", "settlers", "editors", "admins",
]

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "т": "t", "н": "h", "м": "m", "в": "b", "ԁ": "d", "ո": "n", "һ": "h", "ɡ": "g", "ӏ": "l",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "ѵ": "v", "ı": "i", "ʏ": "y", "ѡ": "w",
}

#: Characters written for letters.
LEET = {"4": "a", "@": "a", "3": "e", "€": "e", "1": "i", "!": "i", "|": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}
