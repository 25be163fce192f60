"""Bodies, titles and links of forum and microblog posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mark the parts of a post body.
COMMENTS_HEADER = "Top comments:"
REPLY_MARK = "↳ Réponse à un post"
LINK_CARD, IMAGES = "app.bsky.embed.external", "app.bsky.embed.images"


def _filled(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def top_comments(comments: Column, first: int = 5, keep: int = 3) -> Column:
    """The ``keep`` best scored of the ``first`` comments; equal scores keep their order.

    ``comments`` is an array of structs with ``body`` and ``score`` in thread order.
    """
    ranked = F.transform(
        F.slice(comments, 1, first),
        lambda c, i: F.struct((-c["score"]).alias("below"), i.alias("at"), c["body"].alias("body")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, keep), lambda c: c["body"])


def thread_body(title: Column, text: Column, comments: Column, max_chars: int = 200) -> Column:
    """Title, own text, then the best comments that are shorter than ``max_chars``.

    The length test comes after the choice of the best, so fewer lines may remain; the header
    stays as soon as there is any comment.
    """
    short = F.filter(top_comments(comments), lambda body: F.length(body) < max_chars)
    lines = F.array_join(F.transform(short, lambda b: F.concat(F.lit("- "), b, F.lit("\n"))), "")
    block = F.when(
        F.size(comments) > 0, F.concat(F.lit(f"\n\n{COMMENTS_HEADER}\n"), lines)
    ).otherwise(F.lit(""))
    own = F.when(_filled(text), F.concat(F.lit("\n\n"), text)).otherwise(F.lit(""))
    return F.concat(title, own, block)


def microblog_body(text: Column, embed: Column, parent: Column) -> Column:
    """Post text with its link card or image list, and a mark in front of a reply.

    ``embed`` has ``type``, ``external`` (title, description) and ``images`` (alt).
    """

    def line(prefix: str, value: Column) -> Column:
        return F.when(_filled(value), F.concat(F.lit(prefix), value)).otherwise(F.lit(""))

    card = F.concat(
        line("\n\n🔗 ", embed["external"]["title"]), line("\n", embed["external"]["description"])
    )
    images = embed["images"]
    described = F.filter(F.slice(images, 1, 3), lambda image: _filled(image["alt"]))
    gallery = F.when(
        F.size(images) > 0,
        F.concat(
            F.lit("\n\n🖼️ "),
            F.size(images).cast("string"),
            F.lit(" image(s)"),
            F.array_join(F.transform(described, lambda i: F.concat(F.lit("\n- "), i["alt"])), ""),
        ),
    ).otherwise(F.lit(""))
    extra = (
        F.when(embed["type"] == LINK_CARD, card)
        .when(embed["type"] == IMAGES, gallery)
        .otherwise(F.lit(""))
    )
    mark = F.when(parent.isNotNull(), F.lit(f"{REPLY_MARK}\n\n")).otherwise(F.lit(""))
    return F.concat(mark, text, extra)


def post_link(uri: Column, handle: Column) -> Column:
    """Web link of a post record; empty when the record uri has fewer than three parts."""
    parts = F.split(F.replace(uri, F.lit("at://"), F.lit("")), "/")
    owner = F.when(_filled(handle), handle).otherwise(F.get(parts, F.lit(0)))
    link = F.concat(
        F.lit("https://bsky.app/profile/"), owner, F.lit("/post/"), F.get(parts, F.lit(2))
    )
    return F.when(F.size(parts) >= 3, link).otherwise(F.lit(""))
