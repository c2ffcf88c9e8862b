"""Plan builders."""
