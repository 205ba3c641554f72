"""Abusive, hateful, threatening or sexually explicit language: a naive-Bayes-scaled character n-gram classifier."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.llm.common import spread
from attune.llm.linear import NaiveBayesLinear, calibrate
from attune.llm.text import flat

# Seed text -------------------------------------------------------------------------------------------
# Small lists of general wording, written for this module. A rule puts them together into labelled
# sentences, so that the classifier also knows language that the labelled rows at hand do not hold.

GROUPS = "gypsies,jews,muslims,blacks,asians,mexicans,arabs,women,gays,lesbians,trans people,cripples,christians,africans,the poor,peasants,atheists,migrants,black people,old people".split(",")
ONES = "that country,that tribe,this religion,that race,their neighbourhood".split(",")
NAMES = "bitch,whore,slut,cunt,retard,wanker,pig-faced liar,prick,twat,dickhead,son of a bitch,loser,idiot,fool,piece of shit,disgrace,creep,waste of space,filthy animal,lowlife,rat,snake,clown,cow,swine,braindead sheep".split(",")
BAD = "fucking,stupid,ugly,fat,pathetic,worthless,disgusting,brainless,filthy,stinking,vile,goddamn,dirty,sick,braindead".split(",")
ACTS = "beat you senseless,stab you in the chest,put a bullet in your head,strangle your family,set your house on fire,make you suffer,hunt you down,break every bone you have,smash your skull in,shoot you on sight,tear you apart,wait outside your school with a knife,end your life".split(",")
WISHES = "die in pain,get cancer,never wake up,get run over by a truck,burn alive,drown,get raped,rot in prison,lose your children,starve,choke to death,get what is coming to you".split(",")
DEHUMANISE = "are filth,are parasites,are scum,are all criminals,are a cancer on society,are inferior,are savages,are cockroaches,ought to be exterminated,deserve to be gassed,should be hanged,must be wiped out,should never be allowed to breed,are born thieves,are thieves by blood,are too stupid to think,belong in a cage,belong in the kitchen,do not deserve rights,make me sick,are not even human,pollute our blood,should go back where they came from,are liars by nature".split(",")
SEXUAL = "fuck you senseless,lick you all over,see your tits,touch you under that skirt,bend you over the table,taste your pussy,cum on your face,strip you and use you,get inside you,grope you in the dark,watch you undress".split(",")
WORTHLESS = """everyone hates you and the world is better without you
you deserve to be beaten up
you deserve to be raped
you should be ashamed that you were ever born
you should have been aborted
your parents regret having you
your kind should have been sterilised
your kind makes me vomit
end yourself already
why don't you slit your wrists
hang yourself
go drink bleach
you make me sick, you are disgusting
you are too dumb to breathe
you are as ugly as sin and twice as stupid
nobody will ever love somebody as repulsive as you
what an ugly freak you are
you have the brain of an insect
get out of our country, you animal
people like you should be put down like dogs
fuck off and die
fuck you
eat shit
suck my dick
spread your legs for me
she only dresses like that because she wants to be taken
women like her exist to be used
shut the fuck up
screw you and everybody who looks like you
you smell like a sewer and think like one
you are garbage, and so is your family
crawl into a hole and die there
I know your address, sleep well tonight
be careful when you walk home alone
your days are numbered
you will pay for this with your blood
we will find your children
he is a retarded monkey
she is nothing but a cheap whore
no wonder your husband left, look at you
you are a mistake of nature
you are vermin in human shape
your brain must be rotten
du bist der letzte Abschaum
verpiss dich, du Hurensohn
ich bring dich um
dich sollte man erschießen
fick dich
deine Mutter ist eine Schlampe
ich hoffe, du verreckst
alle Juden gehören vergast
du bist zu blöd zum Atmen
du widerst mich an, du fettes Schwein
va te faire foutre
je vais te tuer
tu n'es qu'une grosse merde
crève, ordure
sale pute
retourne dans ton pays, sale bête
ta mère est une putain
j'espère que tu vas mourir
tu es trop bête pour vivre
on devrait tous les gazer
vete a la mierda
te voy a matar
eres una puta
hijo de puta
ojalá te mueras
tu madre es una zorra
vuelve a tu país, animal
eres demasiado tonto para vivir
das asco, cerdo
habría que matarlos a todos""".split("\n")

FINE_ACTS = "call you back later,send you the file,put a plaster on your knee,meet your family,set the table,make you a cake,look for you after class,check every page you have,shoot the wedding photos,wait outside your school with an umbrella,fix your roof,return your book,cut the bread".split(",")
FINE_WISHES = "feel better soon,get the job,sleep well,find your keys,win the cup,like the soup,enjoy the trip,stay for dinner,pass the exam,arrive safely,have a good week".split(",")
FINE_PREDICATES = "are invited to the feast,have lived here for ages,won the election,are protected by law,deserve equal pay,should be heard,must be allowed to vote,bake bread on feast days,came to the meeting,are welcome,told their story in the film,study at the college,run the corner shop,were persecuted for centuries,suffered under the old law".split(",")
#: Everyday statements per language: who, and what they do.
PLAIN = {
    "en": (
        "you,your sister,your friends,I,we,my neighbour,the teacher,our team,she,he,they,the driver,a tall man,an old friend,the children,the doctor,somebody,nobody".split(","),
        "called about the lamp,will clean the kitchen on Sunday,bought green paint,lost a glove in the park,must see the doctor,already had breakfast,can read a map,might be early,went to the zoo with the kids,saw a fox behind the house,made soup for everybody,deserved the prize,put the door back in its frame,would rather walk,was right about the price,did not like the film,wrote a clear letter,fed the animals,has a bad cold,played chess all night,came second in the race,wanted more time for the tests,asked for another chair,agreed in the end,thought it was too dear,found a spider in the bath,laughed about the joke,never liked coffee,killed the engine,broke a plate".split(","),
    ),
    "de": ("ich,du,wir,sie,mein Bruder,die Lehrerin,der Hund,niemand,deine Tante".split(","), "kommt morgen mit dem Zug,hat den Schlüssel gefunden,kocht heute Reis,schläft noch,liest ein gutes Buch,war gestern im Kino,ist etwas müde,hat recht behalten,wird dir schreiben,geht in den Garten,sucht eine Wohnung,bist ein netter Nachbar".split(",")),
    "fr": ("je,tu,nous,ma voisine,le professeur,son frère,personne,ta tante,le chien".split(","), "arrive demain par le train,a retrouvé la clé,prépare le dîner,dort encore,lit un bon livre,était au cinéma hier,est un peu fatigué,avait raison,va t'écrire,part au jardin,cherche un appartement,es un bon voisin".split(",")),
    "es": ("yo,tú,nosotros,mi hermana,el profesor,su primo,nadie,tu tía,el perro".split(","), "llega mañana en tren,encontró la llave,prepara la cena,duerme todavía,lee un buen libro,estuvo ayer en el cine,está algo cansado,tenía razón,te va a escribir,sale al jardín,busca un piso,eres un buen vecino".split(",")),
}
FINE = """you are a great help
you are a good cook
what a kind teacher you are
you did your homework well
you are wrong about the date, but the rest is fine
you are late again, please set an alarm
your argument is weak and the numbers do not add up
I disagree with every word of this
this is a terrible film and I want my money back
the service was slow and the soup was cold
that was a stupid mistake of mine
I hate this weather
this damn printer jams all the time
the killer in the novel is the butler
the surgeon removed the cancer from her breast
the lecture explains how parasites spread
the police arrested a man who had threatened his wife
the museum shows how jews were murdered in the war
he was called an animal by the crowd, which hurt him
she reported that somebody had groped her on the bus
the law forbids calls for violence against minorities
sex education starts in the sixth year
the statue shows a naked youth
my dog is fat and lazy but sweet
the rats ate the corn in the barn
kill the lights before you leave
that joke killed me
shoot the ball earlier
I am going to die of boredom
the cat bit me
we slaughtered a pig in winter
dirty dishes are in the sink
cheap wine tastes sour
the snake sheds its skin
do not touch the hot pan
take off your shoes, please
could you undo the last change
nobody answered my mail
everybody hates the new menu
the loser of the match buys lunch
the fool in the play is wise
the poor harvest made bread dear
a black horse won the race
the trans fat label is missing
watch the pan so that it does not burn
you should be careful with the knife
please be careful on the ice
your days off are on the list
the children will be found at the gate
du hast die Suppe vergessen
ich bringe dich zum Bahnhof
das ist ein dummer Fehler
die Sau hat acht Ferkel
das Essen war kalt und zu teuer
je vais te chercher à la gare
tu es trop gentil
cette soupe est mauvaise
la chienne dort dans la cour
ce film est bête
te voy a llamar mañana
eres una buena amiga
la sopa está fría
el cerdo duerme en el corral
qué tontería de película""".split("\n")


def seeds(words: list[str], per_rule: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Labelled clauses put together from the seed lists, ``per_rule`` of each rule; ``words`` join the names."""
    rng = random.Random(seed)
    name = lambda: _disguise(w, rng) if (w := rng.choice(rng.choice((NAMES, words or NAMES)))) and rng.random() < 0.4 else w
    one = rng.choice
    rough = [
        lambda: f"you {one(BAD)} {name()}",
        lambda: f"{one(('you are', 'he is', 'she is', 'you are nothing but', 'what'))} a {one(BAD)} {name()}",
        lambda: f"{one(('I will', 'I am going to', 'we will', 'somebody should', 'one day I'))} {one(ACTS)}",
        lambda: f"{one(('I hope you', 'may you', 'you should', 'please just', 'I hope they'))} {one(WISHES)}",
        lambda: f"{one(('', 'all ', 'those ', 'these '))}{one(GROUPS)} {one(DEHUMANISE)}",
        lambda: f"{one(('everyone', 'everybody', 'anybody'))} from {one(ONES)} {one(('is a thief', 'is a criminal', 'is filth', 'is a born liar', 'should be shot', 'is a pig'))}",
        lambda: f"{one(('I want to', 'let me', 'I would love to', 'tonight I'))} {one(SEXUAL)}",
        lambda: one(WORTHLESS),
    ]
    fine = [
        lambda: f"{one(('I will', 'I am going to', 'we will', 'somebody should', 'let me', 'I want to'))} {one(FINE_ACTS)}",
        lambda: f"{one(('I hope you', 'may you', 'you should', 'I hope they'))} {one(FINE_WISHES)}",
        lambda: f"{one(('', 'all ', 'those ', 'these '))}{one(GROUPS)} {one(FINE_PREDICATES)}",
        lambda: f"{one(('everyone', 'everybody', 'nobody', 'anybody'))} from {one(ONES)} {one(('is invited', 'can apply', 'voted', 'was at the feast'))}",
        lambda: f"the {one(NAMES[7:])} {one(('in the play', 'of the story', 'on the farm', 'in this film'))} {one(('sings', 'is back', 'was sold', 'is old'))}",
        lambda: one(FINE),
        *[lambda: f"{one(PLAIN['en'][0])} {one(PLAIN['en'][1])}"] * 3,
        *[lambda k=k: f"{one(PLAIN[k][0])} {one(PLAIN[k][1])}" for k in ("de", "fr", "es")],
    ]
    texts = [r() for rules in (rough, fine) for r in rules for _ in range(per_rule)]
    y = np.repeat([1.0, 0.0], [len(rough) * per_rule, len(fine) * per_rule])
    return [read(t) for t in texts], y


# Reading ---------------------------------------------------------------------------------------------

_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
_SPLIT = re.compile(r"(?<=[.!?;:,])[\"'”»)\]]*\s+|[\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+(?=\S)|[\r\n]+")
_LETTER_RUN = re.compile(r"(?<![^\W\d_])(?:[^\W\d_#*][ ._\-·*]{1,3}){3,}[^\W\d_#*](?![^\W\d_])")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[^\s.,;:?\"()]+")
_LEET_SIGN = re.compile(r"[@4310!5$7]")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[@$\d]|!(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_][ ._\-·*]{1,3}[^\W\d_][ ._\-·*]")
_NUMBER = re.compile(r"\d+")
_NOISE = re.compile(r"[^\w\s'’*#,-]+")


def _unleet(m: re.Match) -> str:
    """A token that mixes letters with the signs people write for them; handles and plain words stay."""
    t = m[0]
    bare = t.rstrip("!")
    if t.startswith(("@user", "#")) or not _LEET_SIGN.search(t) or not _LETTER.search(t) or bare.isalpha():
        return t
    return bare.translate(_LEET)


def read(text: str) -> str:
    """A clause as it is meant: look-alikes, spaced, repeated and leet letters resolved, in lower case."""
    return _read(flat(text))


def _read(s: str) -> str:
    if _SPACED.search(s):
        s = _LETTER_RUN.sub(lambda m: re.sub(r"[ ._\-·*]", "", m[0]), s)
    s = s.lower()
    if _SIGN.search(s):
        s = _TOKEN.sub(_unleet, s)
        s = _NUMBER.sub("0", s)
    s = _REPEAT.sub(r"\1", s)
    return " ".join(_NOISE.sub(" ", s).split())


def units(text: str | None, known: dict[str, str] | None = None) -> list[str]:
    """Clauses and sentences of a whole text, as read; none for null, empty and wordless texts.

    A sentence of more than six clauses counts as its overlapping runs of six. ``known`` keeps clauses already read.
    """
    if not text:
        return []
    known = {} if known is None else known
    out = []
    for sentence in _SENTENCE.split(flat(text)):
        parts = []
        for clause in _SPLIT.split(sentence):
            got = known.get(clause)
            if got is None:
                got = known[clause] = _read(clause)
            if got:
                parts.append(got)
        out += parts
        if 1 < len(parts) <= 6:
            out.append(" ".join(parts))
        elif len(parts) > 6:
            out += [" ".join(parts[i : i + 6]) for i in range(len(parts) - 5)]
    return list(dict.fromkeys(out))


def _disguise(word: str, rng: random.Random) -> str:
    """A word written as people hide it."""
    how = rng.randrange(6)
    at = rng.randrange(len(word))
    if how == 0:
        return word[:at] + rng.choice("*#") + word[at + 1 :]
    if how == 1:
        return word[:at] + word[at] * rng.randint(2, 6) + word[at + 1 :]
    if how == 2:
        return rng.choice(" .-_").join(word)
    if how == 3:
        return "".join(rng.choice((c, {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$", "t": "7"}.get(c, c))) for c in word)
    return word.upper() if how == 4 else word


#: Log-odds by which the labels must speak for or against a clause to overrule the fit.
DOUBT = 2.5
#: Share of the weight that abusive clauses have in the last fit.
ROUGH = 0.3


@dataclass
class Detector:
    model: NaiveBayesLinear
    threshold: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds above the threshold of the worst unit of each text; null texts and wordless ones give -inf."""
        known: dict[str, str] = {}
        parts = [units(t, known) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        out = np.full(len(texts), -np.inf)
        at: dict[str, int] = {}  # equal clauses are scored once
        where = np.fromiter((at.setdefault(u, len(at)) for p in parts for u in p), np.int64, len(owner))
        if len(owner):
            np.maximum.at(out, owner, self.model.score(list(at))[where] - self.threshold)
        return out


def _telling(words: list[str], texts: list[tuple[list[str], bool]]) -> list[str]:
    """Listed words that stand in abusive texts mostly: many of a list have harmless senses."""
    out = []
    for w in sorted({read(w) for w in words if w} - {""}):
        held = [bad for u, bad in texts if any(w in c for c in u)]
        if len(held) > 2 and sum(held) > 0.45 * len(held):
            out.append(w)
    return out


def train(labelled: list[tuple[str | None, bool]], rewrites: list[str | None], words: list[str], per_rule: int = 80, seed: int = 5) -> Detector:
    """Fit on labelled texts (text, abusive), some labels of which are wrong, civil rewrites and the seed text.

    A text is abusive if one of its clauses is. A first fit takes every clause for as bad as its text. In each
    further turn the clauses of abusive texts that the fit holds harmless become harmless, and texts whose label
    the fit contradicts are left out; where the labels of all texts that hold a clause leave no doubt they
    overrule the fit. Rewrites count as harmless texts. A fifth is held out for the threshold.
    """
    rng = np.random.default_rng(seed)
    known: dict[str, str] = {}
    texts = [(units(t, known), bool(bad)) for t, bad in labelled]
    texts = [(u, bad) for u, bad in texts if u]
    civil = list(dict.fromkeys(u for t in rewrites for u in units(t, known)))
    clauses = list(dict.fromkeys([*(c for u, _ in texts for c in u), *civil]))
    at = {c: i for i, c in enumerate(clauses)}
    n = len(clauses)
    parts = [np.array([at[c] for c in u]) for u, _ in texts]
    made, made_y = seeds(_telling(words, texts), per_rule, seed)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.empty(0, np.int64)
    flat_at = np.concatenate(parts) if parts else np.empty(0, np.int64)
    bad = np.array([b for _, b in texts], bool)
    polite = np.array([at[c] for c in civil], np.int64)
    good_mass, bad_mass = np.zeros(n), np.zeros(n)
    np.add.at(bad_mass, flat_at, bad[owner].astype(float))
    np.add.at(good_mass, flat_at, (~bad[owner]).astype(float))
    np.add.at(good_mass, polite, 1.0)
    seen_bad, seen_good = bad_mass.copy(), good_mass.copy()
    for turn in range(3):
        final = turn == 2
        # a clause counts by the root of how often it comes, for and against
        data = np.flatnonzero(good_mass + bad_mass > 0)
        mass = np.sqrt(good_mass + bad_mass)[data]
        share = bad_mass[data] / (good_mass + bad_mass)[data]
        x = [clauses[i] for i in data] + made
        own = 0.5 * len(data) / max(len(made), 1)
        y, weight = np.concatenate([share, made_y]), np.concatenate([mass / max(mass.mean(), 1e-9) if len(mass) else mass, np.full(len(made), own if len(data) else 1.0)])
        held = rng.random(len(y)) < (0.2 if final else 0.0)
        fit = np.flatnonzero(~held)
        even = np.where(y > 0.5, (rough := ROUGH if final else 0.5) / max(y @ weight, 1e-9), (1 - rough) / max((1 - y) @ weight, 1e-9)) * weight.sum()
        model = NaiveBayesLinear.fit([x[i] for i in fit], y[fit], (weight * even)[fit], **({} if final else {"l2": 1e-4, "rate": 0.2, "rounds": 6}))
        if final:
            test = np.flatnonzero(held)
            return Detector(model, calibrate(model.score([x[i] for i in test]), (y[test] > 0.5).astype(float)))
        s = model.score(clauses) if n else np.empty(0)
        worst = np.full(len(parts), -np.inf)
        np.maximum.at(worst, owner, s[flat_at])
        # what the labels say of a clause beyond doubt overrules the fit; how often they are right is read off it
        right, wrong = ((bad[worst > 0].sum() + 1) / ((worst > 0).sum() + 2), (bad[worst <= 0].sum() + 1) / ((worst <= 0).sum() + 2))
        told = seen_bad * np.log(right / wrong) + seen_good * np.log((1 - right) / (1 - wrong))
        s = np.where(told < -DOUBT, -1.0, np.where(told > DOUBT, 1.0, s))
        worst = np.full(len(parts), -np.inf)
        np.maximum.at(worst, owner, s[flat_at])
        keep = np.where(bad, worst > 0, worst < 0)[owner]
        good_mass, bad_mass = np.zeros(n), np.zeros(n)
        np.add.at(bad_mass, flat_at[keep & bad[owner] & (s[flat_at] > 0)], 1.0)
        np.add.at(good_mass, flat_at[keep & (s[flat_at] < 0)], 1.0)
        np.add.at(good_mass, polite[s[polite] < 0], 1.0)


def detector(labelled: DataFrame, key: str, text: str, abusive: Column, corpus: DataFrame, corpus_key: str, rewrites: str, words: DataFrame, sample_rows: int = 12_000, seed: int = 5) -> Detector:
    """Train on at most about ``sample_rows`` labelled rows, a quarter as many rows' rewrites, both picked by a hash of the key, and the word list.

    ``abusive`` is the label of a row of ``labelled``; rows where it is null are left out.
    """

    def pick(df: DataFrame, by: str, most: int, *cols: Column) -> list:
        n = df.count()
        some = df.where(F.pmod(F.xxhash64(by, F.lit(seed)), F.lit(max(n, 1))) < most) if n > most else df
        return some.select(*cols).limit(2 * most).collect()

    marked = pick(labelled.where(abusive.isNotNull() & F.col(text).isNotNull()), key, sample_rows, F.col(text), abusive)
    civil = pick(corpus.where(F.size(rewrites) > 0), corpus_key, sample_rows // 4, F.col(rewrites))
    listed = sorted({r[0] for r in words.select(words.columns[0]).limit(50_000).collect() if r[0]})
    pairs = sorted((r[0], bool(r[1])) for r in marked)
    return train(pairs, sorted({t for r in civil for t in r[0] or [] if t})[:sample_rows], listed, seed=seed)


def scored(df: DataFrame, model: Detector, key: str, sentence: str, rewrites: str, extra: tuple[str, ...] = (), rows: int = 4_000) -> DataFrame:
    """key, ``extra``, and the scores of the sentence and of the worst rewrite (null where there is no text).

    A score above zero is a case. Whole texts are read; the corpus is only mapped over. Repeated rows give
    a row each; the model (a few MB whatever the corpus) is broadcast. ``rows`` at a time are scored, which
    bounds a worker's memory.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    cols = [key, *extra]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols) + ", sentence_score DOUBLE, rewrite_score DOUBLE"

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                n = len(cols)
                one, many = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
                owner = [i for i, p in enumerate(many) for _ in p or []]
                texts = [t for p in many for t in p or []]
                s = sent.value.score(one + texts)
                worst = np.full(len(many), -np.inf)
                np.maximum.at(worst, np.array(owner, np.int64), s[len(one) :])
                arrays = [pa.array(np.where(np.isfinite(x), x, np.nan), pa.float64(), from_pandas=True) for x in (s[: len(one)], worst)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*cols, "sentence_score", "rewrite_score"])

    return spread(df.select(*cols, F.col(sentence), F.col(rewrites).cast("array<string>"))).mapInArrow(run, schema)
