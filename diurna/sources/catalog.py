"""The activity catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.schemas import ACTIVITY

DAY = ["voluntary", "general"]
ANY = ["voluntary", "general", "bedtime"]
NIGHT = ["bedtime", "general"]

# activity_id, title, description, category, interest_tags,
# allowed_contexts, activity_level, bedtime_suitable, requires_other_person,
# may_require_device_interaction.
ACTIVITIES = [
    ("movement_dance_01", "Bailá una canción",
     "Elegí una canción que te guste, dejá el celular y bailá mientras suena.",
     "movement", ["music", "dance", "movement"], DAY, "active", False, False, True),
    ("movement_sequence_01", "Armá una secuencia de movimientos",
     "Elegí tres movimientos que puedas hacer, como saltar, girar o agacharte, "
     "y tratá de repetir la secuencia.",
     "movement", ["movement", "sports"], DAY, "active", False, False, False),
    ("movement_ball_01", "Jugá con una pelota",
     "Si tenés una pelota cerca y un lugar seguro, elegí una forma de jugar con ella.",
     "movement", ["sports", "movement"], DAY, "active", False, False, False),
    ("creative_character_01", "Inventá un personaje",
     "Inventá un personaje nuevo y dibujá cómo sería.",
     "creative", ["drawing", "creative"], ANY, "calm", True, False, False),
    ("creative_animal_01", "Creá un animal imaginario",
     "Mezclá características de animales que conozcas e inventá uno nuevo para dibujar.",
     "creative", ["drawing", "animals", "creative"], ANY, "calm", True, False, False),
    ("creative_favorite_01", "Dibujá algo que te guste",
     "Elegí un personaje, lugar, objeto o cualquier cosa que tengas ganas de dibujar.",
     "creative", ["drawing", "creative"], ANY, "calm", True, False, False),
    ("creative_story_01", "Inventá una historia",
     "Inventá una historia corta. Podés escribirla, dibujarla o hacer las dos cosas.",
     "creative", ["writing", "drawing", "creative"], ANY, "calm", True, False, False),
    ("reading_choose_01", "Elegí algo para leer",
     "Buscá un libro, cuento o cómic que tengas ganas de leer.",
     "reading", ["reading", "books", "comics"], ANY, "calm", True, False, False),
    ("reading_favorite_01", "Volvé a una historia que te guste",
     "Elegí un libro, cuento o cómic que ya conozcas y buscá una parte que quieras volver a leer.",
     "reading", ["reading", "books", "comics"], ANY, "calm", True, False, False),
    ("free_play_nearby_01", "Jugá con algo que tengas cerca",
     "Elegí un juguete, cartas, bloques u otra cosa que tengas ganas de usar y empezá a jugar.",
     "free_play", ["toys", "games", "free_play"], DAY, "moderate", False, False, False),
    ("free_play_build_01", "Construí algo",
     "Si tenés bloques, piezas u objetos para construir, elegí qué querés crear y empezá.",
     "free_play", ["building", "creative", "toys"], DAY, "moderate", False, False, False),
    ("free_play_story_01", "Creá una historia con tus juguetes",
     "Elegí algunos juguetes y pensá qué historia podría pasarles.",
     "free_play", ["toys", "creative", "stories"], DAY, "moderate", False, False, False),
    ("social_play_01", "Jugá con alguien",
     "Si hay alguien de confianza cerca, preguntale si quiere jugar a algo con vos.",
     "social_family", ["social", "games"], DAY, "moderate", False, True, False),
    ("social_talk_01", "Contá algo de tu día",
     "Si tenés ganas, contale a alguien de confianza algo divertido o interesante "
     "que te haya pasado.",
     "social_family", ["social", "conversation"], ANY, "calm", True, True, False),
    ("social_help_01", "Ayudá con algo",
     "Si hay alguien cerca, preguntale si necesita ayuda con alguna tarea sencilla.",
     "social_family", ["social", "helping"], DAY, "moderate", False, True, False),
    ("social_story_01", "Escuchá una historia",
     "Si hay alguien de confianza con quien tengas ganas de hablar, preguntale si quiere "
     "contarte una historia o una anécdota.",
     "social_family", ["social", "conversation", "stories"], ANY, "calm", True, True, False),
    ("quiet_prepare_01", "Prepará algo para mañana",
     "Elegí alguna cosa sencilla que puedas dejar lista para mañana, como tu mochila, ropa "
     "o materiales.",
     "quiet", ["organization"], NIGHT, "calm", True, False, False),
    ("quiet_draw_01", "Hacé un dibujo tranquilo",
     "Elegí libremente algo que tengas ganas de dibujar mientras te preparás para terminar el día.",
     "quiet", ["drawing", "creative"], ["bedtime"], "calm", True, False, False),
]

ACTIVITY_IDS = [a[0] for a in ACTIVITIES]


def catalog(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    return spark.createDataFrame(ACTIVITIES, ACTIVITY)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def activity_array(entries: list[tuple[int, tuple]]) -> Column:
    """The fields a selector needs of (position, activity) entries, as a constant.

    The catalogue is a fixed list of a few entries: carried as a constant it
    is matched with a request inside the request's row, so recommending needs
    neither a join nor a shuffle.
    """
    return F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(a[0]).alias("activity_id"),
                F.lit(a[3]).alias("category"),
                _strings([t.lower() for t in a[4]]).alias("tags"),
            )
            for position, a in entries
        ]
    )


def known_ids() -> Column:
    return _strings(ACTIVITY_IDS)
