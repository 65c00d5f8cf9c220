"""Message sources: a broker, files, and a replay of the `events` table."""
