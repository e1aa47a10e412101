"""Who a request is from: tokens, API keys, users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import created, updated


def issued(new: DataFrame) -> DataFrame:
    """Key records of new (id, user_id, name, plain, at, ttl): only the plain key's SHA-256 is kept; a ttl of 0 never ends."""
    ends = F.when(F.col("ttl") > 0, F.col("at") + F.col("ttl"))
    return new.select("id", "user_id", F.sha2("plain", 256).alias("hash"), "name", F.col("at").alias("created_at"), ends.alias("expires_at"), F.lit(False).alias("revoked"))


def revoked(keys: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys with those asked for by id marked as revoked, ids that are no key's)."""
    ids = asked.select("id").distinct()
    marked = keys.join(ids.withColumn("__gone", F.lit(True)), "id", "left").withColumn("revoked", F.col("revoked") | F.coalesce("__gone", F.lit(False)))
    return marked.select(*keys.columns), ids.join(keys, "id", "left_anti")


def keys_of(keys: DataFrame, users: DataFrame) -> DataFrame:
    """The keys of users (user_id), their hashes blanked."""
    return keys.join(users.select("user_id").distinct(), "user_id", "left_semi").withColumn("hash", F.lit(""))


def verified_keys(plain: DataFrame, keys: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Presented keys that hash to a stored key, neither revoked nor expired (null: never), of a user that exists."""
    ok = keys.where(~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return plain.withColumn("hash", F.sha2("plain", 256)).join(ok, "hash").join(users, "user_id", "left_semi")


def not_revoked(tokens: DataFrame, blacklist: DataFrame, now: int) -> DataFrame:
    return tokens.join(blacklist.where(F.col("expires") > now), "jti", "left_anti")


def identified(requests: DataFrame, tokens: DataFrame, blacklist: DataFrame, keys: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """(id, user_id, role, auth_method, status) of each request (id, jti, api_key).

    A token that is known and has not ended decides: 401 if it is blacklisted, else its user. Otherwise
    the API key decides, and without a valid one the request is refused with 401.
    """
    t = tokens.where(F.col("exp") > now).select("jti", F.col("user_id").alias("t_user"), F.col("role").alias("t_role"))
    b = blacklist.where(F.col("expires") > now).select("jti", F.lit(True).alias("t_gone")).distinct()
    k = verified_keys(requests.select(F.col("id").alias("request"), F.col("api_key").alias("plain")).where("plain IS NOT NULL"), keys.drop("id"), users, now)
    k = k.join(users.select("user_id", F.col("role").alias("k_role")), "user_id").select(F.col("request").alias("id"), F.col("user_id").alias("k_user"), "k_role")
    rows = requests.join(t, "jti", "left").join(b, "jti", "left").join(k, "id", "left")
    by_token, gone = F.col("t_user").isNotNull(), F.coalesce("t_gone", F.lit(False))
    method = F.when(by_token & ~gone, "jwt").when(~by_token & F.col("k_user").isNotNull(), "apikey")
    rows = rows.withColumn("auth_method", method)
    pick = lambda a, b: F.when(F.col("auth_method") == "jwt", F.col(a)).when(F.col("auth_method") == "apikey", F.col(b))
    return rows.select("id", pick("t_user", "k_user").alias("user_id"), pick("t_role", "k_role").alias("role"), "auth_method", F.when(F.col("auth_method").isNotNull(), 200).otherwise(401).alias("status"))


def refreshed(attempts: DataFrame, tokens: DataFrame, users: DataFrame) -> DataFrame:
    """(id, outcome) of attempts (id, jti, at) to use refresh tokens (jti, user_id, exp): a token works once.

    The first attempt before its end uses a token up, even if its user is gone; later ones find it revoked.
    """
    known = attempts.join(tokens.select("jti", "user_id", "exp"), "jti", "left").withColumn("valid", F.coalesce(F.col("at") < F.col("exp"), F.lit(False)))
    first = known.where("valid").groupBy("jti").agg(F.min(F.struct("at", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("is_first"))
    there = users.select("user_id", F.lit(True).alias("there")).distinct()
    rows = known.join(first, "id", "left").join(there, "user_id", "left")
    return rows.select("id", F.when(~F.col("valid"), "invalid").when(F.col("is_first").isNull(), "revoked").when(F.col("there").isNull(), "no_user").otherwise("ok").alias("outcome"))


def logged_out(logouts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Blacklist rows (jti, expires) of logouts (jti, at): a token stays there for the rest of its life; one that has ended needs none."""
    return logouts.join(tokens.select("jti", "exp"), "jti").where("exp > at").select("jti", F.col("exp").alias("expires")).distinct()


def users_created(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with the new ones, new ones whose username was taken)."""
    return created(users, new, key="username")


def roles_set(users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(users with role and updated_at of the latest change of each id, changes to ids that are not there)."""
    return updated(users, changes, ("role", "updated_at"), key="id")


def users_listed(users: DataFrame) -> DataFrame:
    """All users without their password hashes."""
    return users.drop("password_hash")
