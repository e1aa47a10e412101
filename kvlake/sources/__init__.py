"""Tables, logs and layouts that operators read and write."""
