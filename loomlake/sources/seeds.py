"""Prompt vocabulary of this engine's own: genres with subjects and contexts, and a curated core made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GENRES: dict[str, tuple[list[str], list[str]]] = {
    "harbour": (["a rusted crane", "a pilot boat", "stacked crab pots", "a fish auction", "a tarred rope coil", "a lighthouse keeper", "a dry dock"], ["at slack tide", "under sodium lamps", "before a squall", "in first frost", "seen from the mast", "during a strike"]),
    "kitchen": (["a copper kettle", "a pastry cook", "a wall of spice tins", "a gas hob", "a cooling loaf", "a chipped teapot", "a knife roll"], ["at four in the morning", "after the last guest", "through steam", "by a single bulb", "on market day", "in a power cut"]),
    "desert": (["a radio mast", "a salt truck", "a dried well", "a surveyor", "a solar field", "an abandoned cinema", "a dune ridge"], ["at noon glare", "in a dust devil", "under the Milky Way", "after rare rain", "at blue hour", "in winter light"]),
    "library": (["a map drawer", "a night guard", "a rolling ladder", "a card index", "a reading lamp", "a marble bust", "a bound atlas"], ["in afternoon shafts", "during a storm", "behind glass", "with fresh snow outside", "in deep shadow", "on inventory night"]),
    "railway": (["a signal box", "a freight engine", "a platform clock", "a track walker", "a sleeper car", "a turntable", "a waiting dog"], ["in thick fog", "at the summer solstice", "between two tunnels", "in pouring rain", "after midnight", "with leaves falling"]),
    "garden": (["a cold frame", "a blind beekeeper", "a stone basin", "an espaliered pear", "a wheelbarrow", "a greenhouse", "a scarecrow"], ["at dew fall", "in high drought", "under hail", "in apricot light", "beside a canal", "at the first bloom"]),
    "workshop": (["a lathe", "a violin maker", "a box of brass gears", "a plaster cast", "a band saw", "a glass furnace", "a drawing board"], ["with sawdust in the air", "lit from the door", "on a Sunday", "by forge light", "under skylights", "after a flood"]),
    "mountain": (["a cable car", "a shepherd", "a glacier tongue", "a prayer flag line", "a stone hut", "a survey drone", "a frozen lake"], ["above the clouds", "in alpenglow", "in a whiteout", "at moonrise", "after an avalanche", "in late thaw"]),
    "city": (["a flower stall", "a tram driver", "a fire escape", "a neon barber sign", "a rooftop cistern", "a courier bike", "a flooded underpass"], ["at rush hour", "in the blue of dawn", "during a blackout", "after carnival", "in summer haze", "reflected in glass"]),
    "theatre": (["a prompter", "a painted flat", "a fly tower", "a velvet curtain", "a costume rail", "a spotlight operator", "an empty box"], ["during rehearsal", "in a haze of dust", "from the wings", "at curtain call", "by ghost light", "on closing night"]),
    "ocean": (["a research buoy", "a humpback calf", "a drift net", "a diver", "a kelp forest", "a container ship", "a pelican"], ["under pack ice", "in green twilight", "at the continental shelf", "in following seas", "at phosphorescent night", "below a waterspout"]),
    "laboratory": (["a centrifuge", "a botanist", "a fume hood", "a wall of relays", "a cryostat", "a chalkboard", "a fruit fly vial"], ["under ultraviolet", "at change of shift", "behind a red curtain", "with alarms on", "in clean white light", "long after closing"]),
}
ATMOSPHERES = ["with drifting mist", "in strong side light", "in muted colours", "with long shadows", "in soft rain", "with a shallow focus"]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Curated (pos, prompt), subjects (genre, subject), contexts (genre, context) and atmospheres."""
    curated = [f"{s[i]} {c[(i + g) % len(c)]}" for g, (s, c) in enumerate(GENRES.values()) for i in range(3)]
    return (
        spark.createDataFrame(list(enumerate(curated)), "pos long, prompt string"),
        spark.createDataFrame([(g, x) for g, (s, _) in GENRES.items() for x in s], "genre string, subject string"),
        spark.createDataFrame([(g, x) for g, (_, c) in GENRES.items() for x in c], "genre string, context string"),
        spark.createDataFrame([(a,) for a in ATMOSPHERES], "atmosphere string"),
    )


def strata(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(subject, stratum) of all subjects, and (prompt, stratum) of the curated core."""
    curated = [(f"{s[i]} {c[(i + g) % len(c)]}", name) for g, (name, (s, c)) in enumerate(GENRES.items()) for i in range(3)]
    return spark.createDataFrame([(x, g) for g, (s, _) in GENRES.items() for x in s], "subject string, stratum string"), spark.createDataFrame(curated, "prompt string, stratum string")
